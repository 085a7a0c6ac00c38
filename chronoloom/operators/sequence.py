"""Continuity of frame-indexed blocks: gaps, overlaps, islands and blocks cut anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK, previous, running, running_all, unused


def expected_next(blocks: DataFrame, frames_per_block: int | Column, *, keys=(), order=("block_index",), chunk: int = CHUNK) -> DataFrame:
    """Adds expected (the frame the block should start at) and after (the frame expected next).

    A readable block moves the expectation to its end, never back; an unreadable one (ok false) by the
    nominal block size. With s the nominal frames of unreadable blocks up to here, the expectation is
    s + max(0, running max of end - s over readable blocks): two running aggregates instead of a fold.
    """
    order = list(order)
    per = F.lit(frames_per_block) if isinstance(frames_per_block, int) else frames_per_block
    where = {"order": order, "keys": keys, "chunk": chunk}
    nominal = F.when(F.col("ok"), F.lit(0)).otherwise(per).cast("long")
    sums, sums0, most, most0 = unused(blocks.columns, "sums", "sums0", "most", "most0")
    b = running_all(blocks, {sums: ("sum", nominal, False), sums0: ("sum", nominal, True)}, **where)
    end = F.when(F.col("ok"), F.col("start_frame") + F.col("frame_count") - F.col(sums))
    b = running_all(b, {most: ("max", end, False), most0: ("max", end, True)}, **where)
    e = lambda s, m: (F.col(s) + F.greatest(F.lit(0), F.coalesce(m, F.lit(0)))).cast("long")
    return b.withColumns({"after": e(sums, most), "expected": e(sums0, most0)}).drop(sums, sums0, most, most0)


def classified(blocks: DataFrame) -> DataFrame:
    """Adds missing and duplicated frames to blocks(ok, start_frame, frame_count, expected)."""
    ahead = F.col("start_frame") - F.col("expected")
    return blocks.withColumns({
        "missing_frames": F.when(F.col("ok"), F.greatest(F.lit(0), ahead)).otherwise(F.lit(0)).cast("long"),
        "duplicated_frames": F.when(F.col("ok"), F.greatest(F.lit(0), F.least(-ahead, F.col("frame_count")))).otherwise(F.lit(0)).cast("long"),
    })


def wire_sequence(records: DataFrame, *, keys=(), order=("seq",), chunk: int = CHUNK) -> DataFrame:
    """Adds expected, gap, overlap and tail (frames that are new) to wire records(start_frame, frame_count).

    The first record sets the expectation. An early record keeps only what lies beyond it.
    """
    order = list(order)
    r = running(records, "max", F.col("start_frame") + F.col("frame_count"), "expected", order=order, keys=keys, before=True, chunk=chunk)
    r = r.withColumn("expected", F.coalesce("expected", "start_frame"))
    ahead = F.col("start_frame") - F.col("expected")
    return r.withColumns({
        "gap": F.greatest(F.lit(0), ahead).cast("long"),
        "overlap": F.least(F.greatest(F.lit(0), -ahead), F.col("frame_count")).cast("long"),
        "tail": F.least(F.col("frame_count"), F.greatest(F.lit(0), F.col("start_frame") + F.col("frame_count") - F.col("expected"))).cast("long"),
    })


def wire_statistics(sequenced: DataFrame) -> DataFrame:
    """One row: blocks and frames accepted, gaps, gap frames, duplicates and duplicate frames."""
    count = lambda c: F.count(F.when(c, 1))
    return sequenced.agg(
        count(F.col("tail") > 0).alias("blocks"), F.sum("tail").alias("frames"),
        count(F.col("gap") > 0).alias("gaps"), F.sum("gap").alias("gap_frames"),
        count(F.col("start_frame") < F.col("expected")).alias("duplicates"), F.sum("overlap").alias("duplicate_frames"),
    )


def gaps(frames: DataFrame, frame: str = "frame", *, keys=(), start: int = 0, chunk: int = CHUNK) -> DataFrame:
    """start_frame, frame_count of every run of missing frames before a recorded one, counted from `start`."""
    f = frames.select(*keys, F.col(frame).cast("long").alias("frame"))
    (after,) = unused(f.columns, "after")
    f = previous(f, F.col("frame") + 1, after, order=["frame"], keys=list(keys), chunk=chunk)
    f = f.withColumn("start_frame", F.coalesce(after, F.lit(start)).cast("long"))
    return f.where(F.col("frame") > F.col("start_frame")).select(*keys, "start_frame", (F.col("frame") - F.col("start_frame")).alias("frame_count"))


def segments(frames: DataFrame, frame: str = "frame", *, keys=(), chunk: int = CHUNK) -> DataFrame:
    """Adds segment (0, 1, ...) and segment_start: maximal runs of consecutive frames."""
    keys = list(keys)
    before, new = unused([*frames.columns, "segment", "segment_start"], "before", "new")
    f = previous(frames, F.col(frame), before, order=[frame], keys=keys, chunk=chunk)
    begins = F.col(before).isNull() | (F.col(frame) > F.col(before) + 1)
    f = running_all(f.withColumn(new, begins), {"segment": ("sum", F.col(new).cast("long"), False), "segment_start": ("last", F.when(F.col(new), F.col(frame)), False)}, order=[frame], keys=keys, chunk=chunk)
    return f.withColumn("segment", F.col("segment") - 1).drop(before, new)


def reblocked(frames: DataFrame, frames_per_block: int, frame: str = "frame", *, keys=(), chunk: int = CHUNK) -> DataFrame:
    """Blocks cut from segments: start_frame, frame_count, preceding_gap (on a segment's first block), short, block_index.

    Only the last block of a segment can be short.
    """
    keys = list(keys)
    part, end, nth = unused([*keys, "segment", "segment_start", "start_frame", "frame_count", "end_frame", frame], "part", "end", "nth")
    s = segments(frames.select(*keys, frame), frame, keys=keys, chunk=chunk)
    s = s.withColumn(part, F.floor((F.col(frame) - F.col("segment_start")) / frames_per_block))
    b = s.groupBy(*keys, "segment", "segment_start", part).agg(F.min(frame).alias("start_frame"), F.count("*").alias("frame_count"))
    b = b.withColumn("end_frame", F.col("start_frame") + F.col("frame_count"))
    b = running_all(b, {end: ("last", F.col("end_frame"), True), nth: ("sum", F.lit(1).cast("long"), False)}, order=["start_frame"], keys=keys, chunk=chunk)
    gap = F.when(F.col(part) == 0, F.col("start_frame") - F.coalesce(end, F.lit(0))).otherwise(F.lit(0))
    return b.select(*keys, (F.col(nth) - 1).alias("block_index"), "start_frame", "frame_count", gap.cast("long").alias("preceding_gap"), (F.col("frame_count") < frames_per_block).alias("short"))


def resident(frames: DataFrame, frames_per_block: int, frame: str = "frame", *, keys=(), chunk: int = CHUNK) -> DataFrame:
    """One row (per key): resident_frames, what lies in open segments and no whole block has taken, and the number of these segments.

    Only a segment's end can be short, so that is each segment's remainder of whole blocks; the last segment is open even if
    nothing of it is left.
    """
    keys = list(keys)
    s = segments(frames, frame, keys=keys, chunk=chunk).groupBy(*keys, "segment").agg(F.count("*").alias("n"))
    rest = F.col("n") % frames_per_block
    return s.groupBy(*keys).agg(F.coalesce(F.sum(rest), F.lit(0)).alias("resident_frames"), F.count(F.when(rest > 0, 1)).alias("open_segments"))


def wire_totals(sequenced: DataFrame, statistics: DataFrame) -> DataFrame:
    """wire_statistics per stream, with crc_failures and corrupt_bytes of a decoder's statistics(stream, ...); streams without records have zeros."""
    count = lambda c: F.count(F.when(c, 1))
    own = sequenced.groupBy("stream").agg(
        count(F.col("tail") > 0).alias("blocks"), F.sum("tail").alias("frames"), count(F.col("gap") > 0).alias("gaps"), F.sum("gap").alias("gap_frames"),
        count(F.col("start_frame") < F.col("expected")).alias("duplicates"), F.sum("overlap").alias("duplicate_frames"),
    )
    names = ("blocks", "frames", "gaps", "gap_frames", "duplicates", "duplicate_frames")
    return statistics.select("stream", "corrupt_bytes", "crc_failures").join(own, "stream", "left").select("stream", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "corrupt_bytes", "crc_failures")


def session_runs(events: DataFrame, micros: Column, gap_micros: int, *, keys, chunk_micros: int = 86_400_000_000) -> DataFrame:
    """Sessions of events per key: runs whose neighbours lie at most gap_micros apart. Columns: keys, begin, end, events.

    Chunks of time are sorted apart, so that no task gets all events of a frequent key; events without a time belong to none.
    """
    keys = list(keys)
    at, before, new, session = unused([*keys, "begin_us", "end_us", "events"], "at", "before", "new", "session")
    where = {"order": [at], "keys": keys, "chunk": chunk_micros}
    # Events of one time are one row: their order among each other means nothing.
    e = events.select(*keys, micros.alias(at)).where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.count("*").alias("events"))
    e = previous(e, F.col(at), before, **where)
    e = e.withColumn(new, F.coalesce((F.col(at) - F.col(before) > gap_micros).cast("long"), F.lit(0)))
    e = running(e, "sum", F.col(new), session, **where)
    return e.groupBy(*keys, session).agg(F.min(at).alias("begin_us"), F.max(at).alias("end_us"), F.sum("events").alias("events")).drop(session)
