"""Validation of a recording: counters, first discrepancies, verdict and the report's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import integer
from .ordered import CHUNK, previous, unused
from .sequence import classified, expected_next

# Exit codes and results.
PASS, FAIL, TRUNCATED, UNREADABLE, USAGE = 0, 1, 2, 3, 64
RESULTS = {PASS: "PASS", FAIL: "FAIL", TRUNCATED: "PASS (TRUNCATED)"}


def block_findings(blocks: DataFrame, *, frames_per_block: int, channels: int, order=("block_index",), keys=(), chunk: int = CHUNK) -> DataFrame:
    """Per block the values missing, duplicated, recorded, corrupt and incorrect.

    blocks: block_index, ok (header readable), start_frame, frame_count, payload_ok, incorrect (values that
    differ bit by bit, counted where the payload is sound).
    """
    b = classified(expected_next(blocks, frames_per_block, order=order, keys=keys, chunk=chunk))
    nominal, own = F.lit(frames_per_block * channels), F.col("frame_count") * channels
    return b.withColumns({
        "missing": F.col("missing_frames") * channels,
        "duplicated": F.col("duplicated_frames") * channels,
        "recorded": F.when(F.col("ok"), own).otherwise(F.lit(0)).cast("long"),
        "corrupt": F.when(~F.col("ok"), nominal).when(~F.col("payload_ok"), own).otherwise(F.lit(0)).cast("long"),
        "incorrect": F.when(F.col("ok") & F.col("payload_ok"), F.col("incorrect")).otherwise(F.lit(0)).cast("long"),
    })


def report(findings: DataFrame, *, trailing_missing: Column | int = 0, declared: int | None = None, expected_values: int | None = None, trusted: bool = True, truncated: bool = False) -> DataFrame:
    """One row of counters and verdict. declared: lost values that the file itself states (None: not trusted)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("recorded", "missing", "duplicated", "incorrect", "corrupt")]
    r = findings.agg(*sums)
    r = r.withColumn("missing", F.col("missing") + (trailing_missing if isinstance(trailing_missing, Column) else F.lit(trailing_missing)))
    agrees = F.lit(None).cast("boolean") if declared is None else F.col("missing") == F.lit(declared)
    r = r.withColumn("ledger_agrees", agrees)
    r = r.withColumn("expected", F.lit(expected_values).cast("long") if expected_values is not None else F.col("recorded"))
    return r.withColumn("exit_code", verdict(F.lit(not trusted or truncated))).withColumn("result", result_text(F.col("exit_code")))


def discrepant(c=F.col) -> Column:
    return c("missing") + c("duplicated") + c("incorrect") + c("corrupt")


def verdict(truncated: Column) -> Column:
    failed = (discrepant() > 0) | F.coalesce(~F.col("ledger_agrees"), F.lit(False))
    return F.when(failed, FAIL).when(truncated, TRUNCATED).otherwise(PASS)


def result_text(code: Column) -> Column:
    out = F.lit("UNREADABLE")
    for k, v in RESULTS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def first_of_class(findings: DataFrame, channels: int, *, order=("block_index",)) -> DataFrame:
    """class, block_index, frame, value_count of the first block of each class of discrepancy, in file order."""
    place = {"missing": F.col("expected"), "duplicated": F.col("start_frame"), "corrupt": F.col("start_frame")}
    rows = F.array(*[F.struct(F.lit(k).alias("class"), f.cast("long").alias("frame"), F.col(k).alias("value_count")) for k, f in place.items()])
    long = findings.select(*order, F.inline(rows)).where("value_count > 0")
    first = long.groupBy("class").agg(F.min_by(F.struct(*order, "frame", "value_count"), F.struct(*order)).alias("f"))
    return first.select("class", *[F.col(f"f.{o}").alias(o) for o in order], "f.frame", "f.value_count", (F.col("f.frame") * channels).alias("value_index"))


def first_incorrect(mismatches: DataFrame, channels: int) -> DataFrame:
    """The first wrong value in file order of mismatches(block_index, channel, frame, expected, actual)."""
    f = mismatches.agg(F.min_by(F.struct("block_index", "channel", "frame", "expected", "actual"), F.struct("block_index", "channel", "frame")).alias("f")).select("f.*")
    return f.where("frame IS NOT NULL").withColumn("value_index", F.col("frame") * channels + F.col("channel"))


def result_lines(r: DataFrame) -> DataFrame:
    """line_number, line: the fixed summary."""
    lines = [
        F.concat(F.lit("Expected: "), integer(F.col("expected")), F.lit(" samples")),
        F.concat(F.lit("Recorded: "), integer(F.col("recorded")), F.lit(" samples")),
        F.concat(F.lit("Missing:   "), integer(F.col("missing"))),
        F.concat(F.lit("Duplicated: "), integer(F.col("duplicated"))),
        F.concat(F.lit("Incorrect:  "), integer(F.col("incorrect"))),
        F.concat(F.lit("Result: "), F.col("result")),
    ]
    corrupt = F.when(F.col("corrupt") > 0, F.array(F.concat(F.lit("Corrupt:    "), integer(F.col("corrupt")), F.lit("   (CRC-failed blocks, counted separately)")))).otherwise(F.array().cast("array<string>"))
    return r.select(F.posexplode(F.concat(F.array(*lines), corrupt)).alias("line_number", "line"))


def checks(r: DataFrame) -> DataFrame:
    """check, status (pass, fail, warn, pending) of the five questions that a report answers."""
    ok = lambda c: F.when(c == 0, "pass").otherwise("fail")
    ledger = F.when(F.col("ledger_agrees").isNull(), "pending").when(F.col("ledger_agrees"), "pass").otherwise("fail")
    complete = F.when((F.col("exit_code") == TRUNCATED) | F.col("ledger_agrees").isNull(), "warn").otherwise("pass")
    rows = [("Sample values", ok(F.col("incorrect"))), ("Sequence", ok(F.col("missing") + F.col("duplicated"))), ("Checksums", ok(F.col("corrupt"))), ("Drop log", ledger), ("File", complete)]
    return r.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in rows])))


def headline(code: Column) -> Column:
    """The verdict in a word."""
    return F.when(code == PASS, "Passed").when(code == TRUNCATED, "Passed so far").when(code == FAIL, "Failed").otherwise("Could not verify")


def place_text(value_index: Column, channel: Column, frame: Column, rate: float) -> Column:
    """Where a discrepancy is: value, channel, frame, and time to the microsecond."""
    t = F.format_string("%.6f", frame / F.lit(float(rate)))
    return F.concat(F.lit("value #"), integer(value_index), F.lit("  (channel "), F.coalesce(channel, F.lit(0)).cast("string"), F.lit(", frame "), integer(frame), F.lit(", t="), t, F.lit("s)"))


# How the lines about first discrepancies begin, in their order.
_FIRST = {"missing": "First missing:    ", "duplicated": "First duplicated: ", "incorrect": "First incorrect:  ", "corrupt": "First corrupt:    "}


def detail_lines(firsts: DataFrame, rate: float) -> DataFrame:
    """line_number, line about the first discrepancy of each class.

    firsts(class, block_index, frame, value_count, value_index, channel, expected, actual, byte_offset) has a row per class at
    most; channel, expected, actual and byte_offset may be null where they say nothing.
    """
    at = place_text(F.col("value_index"), F.col("channel"), F.col("frame"), rate)
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in _FIRST.items() for x in kv]), F.col("class"))
    number = lambda c: F.col(c).cast("double").cast("string")
    pad = F.lit(" " * len(_FIRST["missing"]))
    lines = (
        F.when(F.col("class") == "missing", F.array(F.concat(begin, at), F.concat(pad, integer(F.col("value_count")), F.lit(" values"))))
        .when(F.col("class") == "incorrect", F.array(F.concat(begin, at), F.concat(pad, F.lit("expected "), number("expected"), F.lit(", got "), number("actual"), F.lit(", byte offset "), integer(F.col("byte_offset")))))
        .when(F.col("class") == "corrupt", F.array(F.concat(begin, F.lit("block #"), F.col("block_index").cast("string"), F.lit(" at byte "), integer(F.col("byte_offset")))))
        .otherwise(F.array(F.concat(begin, at)))
    )
    order = F.array_position(F.array(*map(F.lit, _FIRST)), F.col("class"))
    return firsts.select(order.alias("o"), F.posexplode(lines).alias("k", "line")).select((F.col("o") * 2 + F.col("k") - 2).cast("int").alias("line_number"), "line")


def ledger_line(declared: Column, derived: Column, agrees: Column) -> Column:
    """What the header's ledger and the gaps found say of each other; null where nothing was lost or nothing was declared."""
    told = F.concat(F.lit("Drop ledger:      header declares "), integer(declared), F.lit(" dropped values, validator derived "), integer(derived), F.lit(" — "), F.when(agrees, "AGREE").otherwise("DISAGREE: the recording contradicts itself"))
    return F.when(agrees.isNotNull() & ((declared > 0) | (derived > 0)), told)


def summary_line(values: Column, seconds: Column, check_crc: bool = True) -> Column:
    """How many values were validated in which time."""
    rate = F.when(seconds > 0, F.floor(values / seconds + 0.5)).otherwise(F.lit(0))
    return F.concat(F.lit("validated "), integer(values), F.lit(" values in "), F.format_string("%.2f", seconds.cast("double")), F.lit(" s ("), integer(rate), F.lit(" values/s), CRC " + ("on" if check_crc else "off")))


def sweep(blocks: DataFrame, *, order=("block_index",), keys=(), chunk: int = CHUNK) -> DataFrame:
    """One row (per key) about blocks(ok, start_frame, frame_count, payload_ok) read one after the other: blocks, bad_headers, bad_payloads, gaps
    and gap_frames.

    Unlike the validator, which counts from frame 0, a sweep expects nothing of the first readable block, and of each
    further one that it begins where the readable block before it ended, wherever that was.
    """
    keys = list(keys)
    (before,) = unused(blocks.columns, "before")
    b = previous(blocks, F.when(F.col("ok"), F.col("start_frame") + F.col("frame_count")), before, order=list(order), keys=keys, chunk=chunk)
    ahead = F.when(F.col("ok"), F.greatest(F.lit(0), F.col("start_frame") - F.col(before)))
    n = lambda c: F.count(F.when(c, 1))
    return b.groupBy(*keys).agg(F.count("*").alias("blocks"), n(~F.col("ok")).alias("bad_headers"), n(F.col("ok") & ~F.col("payload_ok")).alias("bad_payloads"), n(ahead > 0).alias("gaps"), F.coalesce(F.sum(ahead), F.lit(0)).alias("gap_frames"))
