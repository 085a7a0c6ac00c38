"""Ledgers of lost frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import chains
from .ordered import CHUNK, previous, running, unused

# Why frames were lost.
CAUSES = {
    1: "GENERATOR_RING_FULL",
    2: "RECORDER_RING_FULL",
    3: "PACING_RESYNC",
    4: "TRANSPORT_GAP",
    5: "CORRUPT_FRAMES",
    6: "GENERATOR_DISCONNECT",
    7: "SHUTDOWN_UNFLUSHED",
}
#: Entries a recording lists at most; totals stay exact beyond.
MOST_ENTRIES = 65536


def cause_name(code: Column) -> Column:
    known = F.create_map(*[x for k, v in CAUSES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, code.cast("int")), F.format_string("unknown(%d)", code))


def coalesced(records: DataFrame, *, keys=(), order: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Loss records(seq, start_frame, frame_count, cause_code) with neighbours joined that share a cause and touch.

    Empty records count for nothing. entry numbers the result from 0. For a ledger with room for `most` entries see capped.
    """
    keys = list(keys)
    r = records.where(F.col("frame_count") > 0)
    (before,) = unused(records.columns, "before")
    r = previous(r, F.struct((F.col("start_frame") + F.col("frame_count")).alias("end"), F.col("cause_code").alias("cause")), before, order=[order], keys=keys, chunk=chunk)
    joins = F.coalesce((F.col(f"{before}.end") == F.col("start_frame")) & (F.col(f"{before}.cause") == F.col("cause_code")), F.lit(False))
    r = running(r, "sum", (~joins).cast("long"), "entry", order=[order], keys=keys, chunk=chunk)
    out = r.groupBy(*keys, (F.col("entry") - 1).alias("entry")).agg(F.min("start_frame").alias("start_frame"), F.sum("frame_count").alias("frame_count"), F.first("cause_code").alias("cause_code"))
    return out


def capped(records: DataFrame, most: int, *, order: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """A ledger with room for `most` entries: entry, start_frame, frame_count, cause_code, and on every row truncated and
    dropped_frames (of all records, exactly).

    Up to the last entry it is `coalesced`. From then on a record extends that entry if it begins where the entry ends and has
    its cause, whatever was turned away between; all others are lost to the list. So the records that extend it form a
    chain: after each, the next one is the first later record that begins where it ends.
    """
    if most < 1:
        raise ValueError("a ledger has room for one entry at least")
    r = records.where(F.col("frame_count") > 0).select(F.col(order).cast("long").alias("seq"), F.col("start_frame").cast("long").alias("start_frame"), F.col("frame_count").cast("long").alias("frame_count"), "cause_code")
    entries = coalesced(r, chunk=chunk)
    r = previous(r, F.struct((F.col("start_frame") + F.col("frame_count")).alias("end"), F.col("cause_code").alias("cause")), "before", order=["seq"], chunk=chunk)
    joins = F.coalesce((F.col("before.end") == F.col("start_frame")) & (F.col("before.cause") == F.col("cause_code")), F.lit(False))
    r = running(r, "sum", (~joins).cast("long"), "entry", order=["seq"], chunk=chunk)
    r = r.select("seq", "start_frame", "frame_count", "cause_code", (F.col("entry") - 1).alias("entry"))
    # The chain: the last stored entry's last record, and what comes behind it with its cause.
    tip = r.where(F.col("entry") == most - 1).agg(F.max("seq").alias("tip"), F.max_by("cause_code", "seq").alias("cause"))
    late = r.join(F.broadcast(tip)).where((F.col("seq") >= F.col("tip")) & (F.col("cause_code") == F.col("cause")))  # one row
    ends = late.select("seq", (F.col("start_frame") + F.col("frame_count")).alias("place"), F.lit(1).alias("asks"))
    begins = late.where("seq > tip").select("seq", F.col("start_frame").alias("place"), F.lit(0).alias("asks"))
    later = W.partitionBy("place").orderBy("seq", "asks").rowsBetween(1, W.unboundedFollowing)
    named = ends.unionByName(begins).withColumn("next", F.min(F.when(F.col("asks") == 0, F.col("seq"))).over(later)).where("asks = 1")
    nodes = named.join(F.broadcast(tip)).select(F.lit("").alias("key"), F.col("seq").alias("node"), "next", (F.col("seq") == F.col("tip")).alias("root"))
    more = chains.followed(nodes, chunk=chunk).withColumnRenamed("node", "seq")
    extra = late.where("seq > tip").join(more.select("seq"), "seq").agg(F.coalesce(F.sum("frame_count"), F.lit(0)).alias("extra"), F.count("*").alias("used"))
    rest = r.where(F.col("entry") >= most).agg(F.count("*").alias("beyond"))
    whole = r.agg(F.coalesce(F.sum("frame_count"), F.lit(0)).alias("dropped_frames"))
    out = entries.where(F.col("entry") < most).join(F.broadcast(extra)).join(F.broadcast(rest)).join(F.broadcast(whole))  # one row each
    longer = F.col("frame_count") + F.when(F.col("entry") == most - 1, F.col("extra")).otherwise(F.lit(0))
    return out.select("entry", "start_frame", longer.alias("frame_count"), "cause_code", (F.col("beyond") > F.col("used")).alias("truncated"), "dropped_frames")


def lost_time(marks: DataFrame) -> DataFrame:
    """One row of markers(onset, duration): gaps and lost_seconds."""
    return marks.agg(F.count("*").alias("gaps"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("lost_seconds"))


def indexed(ledger: DataFrame, channels: int, rate: float) -> DataFrame:
    """Entries in frames, values and seconds, with the cause's name."""
    return ledger.select(
        "start_frame", "frame_count",
        (F.col("start_frame") * channels).alias("start_value"), (F.col("frame_count") * channels).alias("value_count"),
        (F.col("start_frame") / F.lit(float(rate))).alias("start_seconds"), (F.col("frame_count") / F.lit(float(rate))).alias("duration_seconds"),
        cause_name(F.col("cause_code")).alias("cause"),
    )


def markers(ledger: DataFrame, rate: float) -> DataFrame:
    """Loss as annotations: onset and duration in seconds."""
    return ledger.select((F.col("start_frame") / F.lit(float(rate))).alias("onset"), (F.col("frame_count") / F.lit(float(rate))).alias("duration"), cause_name(F.col("cause_code")).alias("cause"))


def markers_in(marks: DataFrame, windows: DataFrame) -> DataFrame:
    """Markers(onset, duration) that overlap windows(window_id, begin, end), clipped to them.

    Both are dealt to second-long cells, so overlaps meet by an equi-join; a pair counts in its first common cell.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
    m = marks.withColumn("stop", F.col("onset") + F.col("duration")).withColumn("cell", cells(F.col("onset"), F.col("stop")))
    w = windows.withColumn("cell", cells(F.col("begin"), F.col("end")))
    both = m.join(w, "cell").where((F.col("onset") < F.col("end")) & (F.col("stop") > F.col("begin")) & (F.col("cell") == F.greatest(F.floor("onset"), F.floor("begin"))))
    return both.select("window_id", F.greatest("onset", "begin").alias("clip_begin"), F.least("stop", "end").alias("clip_end"), "onset", "duration")


def agreement(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Entries of two ledgers side by side: both, declared only, or derived only."""
    a, b = declared.select("start_frame", "frame_count", F.lit(1).alias("x")), derived.select("start_frame", "frame_count", F.lit(1).alias("y"))
    side = F.when(F.col("x").isNull(), "derived only").when(F.col("y").isNull(), "declared only").otherwise("both")
    return a.join(b, ["start_frame", "frame_count"], "full_outer").select("start_frame", "frame_count", side.alias("side"))


def unaccounted(offered: DataFrame, written: DataFrame, lost: DataFrame) -> DataFrame:
    """Frames offered that are neither written nor in the ledger, and the reverse: empty for a sound recording."""
    known = written.select("frame").unionAll(lost.select(F.explode(F.sequence(F.col("start_frame"), F.col("start_frame") + F.col("frame_count") - 1)).alias("frame")))
    o = offered.select("frame")
    return o.exceptAll(known).withColumn("side", F.lit("lost without entry")).unionAll(known.exceptAll(o).withColumn("side", F.lit("never offered")))


def totals(records: DataFrame, channels: int) -> DataFrame:
    """One row: dropped_frames, dropped_values (over all channels) and records of a ledger; zeros for an empty one."""
    frames = F.coalesce(F.sum("frame_count"), F.lit(0))
    return records.agg(frames.alias("dropped_frames"), (frames * channels).alias("dropped_values"), F.count("*").alias("records"))
