"""Finding blocks and states by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .ordered import CHUNK, running, unused


def block_address(block: Column, header_bytes: int, stride: int) -> Column:
    return (F.lit(header_bytes) + block * stride).cast("long")


def clipped(blocks: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """The part of each block inside [first, last): clip_start, clip_count, skip (frames of the block before it)."""
    a, z = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    start = F.greatest(a, F.col("start_frame"))
    stop = F.least(z, F.col("start_frame") + F.col("frame_count"))
    b = blocks.withColumns({"clip_start": start, "clip_count": stop - start, "skip": start - F.col("start_frame")})
    return b.where(F.col("clip_count") > 0)


def find_blocks(targets: DataFrame, blocks: DataFrame, frames_per_block: int) -> DataFrame:
    """The block of each target(frame): target, block_index, method.

    closed-form: the block at floor(frame / nominal size) holds it; binary-search: another block does; after-gap: none
    does, and block_index is the first block after it; not found: it lies beyond the end. One ordered pass over
    blocks and targets instead of a range join.
    """
    t = targets.select(F.col("frame").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("block_index"), F.lit(None).cast("long").alias("stop"))
    b = blocks.select(F.col("start_frame").alias("at"), F.lit(0).alias("side"), "block_index", (F.col("start_frame") + F.col("frame_count")).alias("stop"))
    u = running(t.unionByName(b), "last", F.when(F.col("side") == 0, F.struct("block_index", "stop")), "held", order=["at", "side"])
    u = u.where("side = 1")
    inside = F.coalesce(F.col("held.stop") > F.col("at"), F.lit(False))
    guess = F.floor(F.col("at") / frames_per_block)
    total = blocks.agg(F.max("block_index").alias("last_block"))
    u = u.crossJoin(total)  # one row
    after = F.coalesce(F.col("held.block_index") + 1, F.lit(0))
    method = F.when(inside & (F.col("held.block_index") == guess), "closed-form").when(inside, "binary-search").when(after <= F.col("last_block"), "after-gap").otherwise("not found")
    block = F.when(inside, F.col("held.block_index")).when(after <= F.col("last_block"), after)
    return u.select(F.col("at").alias("target"), block.cast("long").alias("block_index"), method.alias("method"))


def read_cost(blocks: Column, channels: Column, frames: Column, width: int = 4, header: int = 64) -> Column:
    """Bytes and calls of reading some channels of some frames across some blocks."""
    return F.struct((blocks * header + channels * frames * width).cast("long").alias("bytes"), (blocks * (channels + 1)).cast("long").alias("calls"))


def transport_positions(clock: DataFrame, commands: DataFrame, *, rate: float, end_frame: int, chunk: int = CHUNK) -> DataFrame:
    """Playback position at each clock(at_us): from the last command(at_us, playing, anchor, speed) at or before it.

    Playing moves on from the anchor by elapsed time, rate and speed; both stay within [0, end_frame]. Before the
    first command the position is 0.
    """
    c = commands.select("at_us", F.lit(0).alias("side"), F.struct("at_us", "playing", "anchor", "speed").alias("command"))
    t = clock.select("at_us", F.lit(1).alias("side"), F.lit(None).cast(c.schema["command"].dataType).alias("command"))
    u = running(c.unionByName(t), "last", F.col("command"), "held", order=["at_us", "side"], chunk=chunk).where("side = 1")
    moved = F.floor((F.col("at_us") - F.col("held.at_us")) / F.lit(1e6) * F.lit(float(rate)) * F.col("held.speed"))
    at = F.when(F.col("held.playing"), F.greatest(F.lit(0), F.least(F.col("held.anchor") + moved, F.lit(end_frame)))).otherwise(F.least(F.col("held.anchor"), F.lit(end_frame)))
    return u.select("at_us", F.when(F.col("held").isNull(), 0).otherwise(at).cast("long").alias("position"))


def speed(x: Column) -> Column:
    """Playback speed within its bounds."""
    return F.greatest(F.lit(0.05), F.least(F.lit(16.0), x))


def older_than_newest(names: DataFrame, keep: int, open_name: str | None = None) -> DataFrame:
    """Recordings to prune: all but the newest `keep` by name, and never the open one."""
    newest = names.orderBy(F.col("name").desc()).limit(keep)
    rest = names.join(newest.select("name"), "name", "left_anti")
    return rest if open_name is None else rest.where(F.col("name") != open_name)


def with_siblings(files: DataFrame, pruned: DataFrame) -> DataFrame:
    """Files that belong to pruned recordings: those with the same stem."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    return files.withColumn("stem", stem(F.col("file"))).join(pruned.select(stem(F.col("name")).alias("stem")).distinct(), "stem", "left_semi").drop("stem")


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n of each before it shuffles."""
    (nth,) = unused(df.columns, "nth")
    return df.withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(nth) <= n).drop(nth)
