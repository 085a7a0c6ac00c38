"""The deterministic multi-channel test signal, as Spark columns and as a numpy kernel.

Every value is a pure function of channel and frame, so any range can be recomputed on any executor.
Integer steps use 32-bit wrap-around arithmetic; real steps are double precision with one rounding to
single precision at the end. The order of the real operations is part of the definition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signal's definition.
SIGNAL_NAME = "tri+saw+hash32/v1"
FRAME_FACTOR, CHANNEL_FACTOR, MIX_FACTOR = 0x9E3779B1, 0x85EBCA77, 0x2545F491
PERIOD = 65536
DITHER_SCALE = 0.03125
CHANNEL_STEP = 32

_U32 = 0xFFFFFFFF


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^32 for 0 <= x < 2^32: the halves of x keep every product within 63 bits."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = (F.shiftrightunsigned(x, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)) * F.lit(0x10000)
    return (low + high).bitwiseAND(F.lit(_U32))


def hash32(channel: Column, frame: Column) -> Column:
    """An unsigned 32-bit scramble of (channel, frame), as BIGINT."""
    n = frame.cast("long").bitwiseAND(F.lit(_U32))
    x = _times(n, FRAME_FACTOR).bitwiseXOR(_times(channel.cast("long") + 1, CHANNEL_FACTOR))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    x = _times(x, MIX_FACTOR)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 13))


def carrier(channel: Column, frame: Column) -> Column:
    """A triangle and a sawtooth whose periods differ from channel to channel."""
    c, n = channel.cast("long"), frame.cast("long")
    fast, slow = c * 2 + 1, (c * 7).bitwiseAND(F.lit(31)) * 2 + 3
    a = ((n * fast) % PERIOD).cast("double") / F.lit(float(PERIOD))
    b = ((n * slow + c * 512) % PERIOD).cast("double") / F.lit(float(PERIOD))
    triangle = F.lit(4.0) * F.abs(a - F.lit(0.5)) - F.lit(1.0)
    saw = F.lit(2.0) * b - F.lit(1.0)
    return (F.lit(0.5) + c.cast("double") / F.lit(64.0)) * triangle + F.lit(0.25) * saw


def value(channel: Column, frame: Column, dither: bool = True) -> Column:
    """The recorded value, FLOAT."""
    base = carrier(channel, frame)
    if dither:
        base = base + F.lit(DITHER_SCALE) * (hash32(channel, frame).cast("double") / F.lit(4294967296.0) - F.lit(0.5))
    return (base + channel.cast("double") / F.lit(float(CHANNEL_STEP))).cast("float")


def values(channels: np.ndarray, start: int, count: int, dither: bool = True) -> np.ndarray:
    """float32 (len(channels), count): the same values from numpy, for block kernels."""
    c = np.asarray(channels, np.int64)
    n = np.arange(start, start + count, dtype=np.int64)
    step = (n & (PERIOD - 1)).astype(np.int32)[None, :]
    one = lambda x, kind: x.astype(kind)[:, None]
    # Scaling by powers of two is exact, so the order of the real operations is that of value().
    out = (step * one(2 * c + 1, np.int32) & (PERIOD - 1)) * (1.0 / PERIOD)
    out -= 0.5
    np.abs(out, out=out)
    out *= 4.0
    out -= 1.0
    out *= one(0.5 + c / 64, np.float64)
    part = (step * one(((7 * c) & 31) * 2 + 3, np.int32) + one(c * 512, np.int32) & (PERIOD - 1)) * (2.0 / PERIOD)
    part -= 1.0
    part *= 0.25
    out += part
    if dither:
        with np.errstate(over="ignore"):
            x = (n.astype(np.uint32) * np.uint32(FRAME_FACTOR))[None, :] ^ one((c + 1).astype(np.uint32) * np.uint32(CHANNEL_FACTOR), np.uint32)
            x ^= x >> np.uint32(15)
            x *= np.uint32(MIX_FACTOR)
            x ^= x >> np.uint32(13)
        np.multiply(x, 1.0 / 4294967296.0, out=part)
        part -= 0.5
        part *= DITHER_SCALE
        out += part
    out += one(c / CHANNEL_STEP, np.float64)
    return out.astype(np.float32)


def samples(spark: SparkSession, channels: int, frames: int, start: int = 0, dither: bool = True) -> DataFrame:
    """frame, channel, value: generated where it is used, one task per range of frames."""
    _positive(channels)
    grid = spark.range(start, start + frames).select(F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    return grid.select("frame", "channel", value(F.col("channel"), F.col("frame"), dither).alias("value"))


def interleaved(spark: SparkSession, channels: int, frames: int, start: int = 0, dither: bool = True) -> DataFrame:
    """frame, values: one array over all channels per frame."""
    _positive(channels)
    each = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: value(c, F.col("frame"), dither))
    return spark.range(start, start + frames).select(F.col("id").alias("frame")).select("frame", each.alias("values"))


def planar(spark: SparkSession, channels: int, frames: int, block: int, dither: bool = True) -> DataFrame:
    """block_index, channel, start_frame, values: one array per block and channel; the last block may be short."""
    _positive(channels)
    blocks = spark.range(-(-frames // block)).select(F.col("id").alias("block_index"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    blocks = blocks.withColumn("start_frame", F.col("block_index") * block)
    last = F.least(F.col("start_frame") + block, F.lit(frames)) - 1
    each = F.transform(F.sequence(F.col("start_frame"), last), lambda n: value(F.col("channel"), n, dither))
    return blocks.select("block_index", "channel", "start_frame", each.alias("values"))


def fill_interleaved(frames: DataFrame, dither: bool = True) -> DataFrame:
    """Adds values, one array over a frame's channels, to frames(frame, channels)."""
    each = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: value(c, F.col("frame"), dither))
    return frames.withColumn("values", F.when(F.col("channels") > 0, each).otherwise(F.array().cast("array<float>")))


def fill_planar(blocks: DataFrame, dither: bool = True) -> DataFrame:
    """A row per channel of blocks(start_frame, frame_count, channels), with channel and values; empty blocks have none."""
    rows = blocks.where("channels > 0 AND frame_count > 0").withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    each = F.transform(F.sequence(F.col("start_frame"), F.col("start_frame") + F.col("frame_count") - 1), lambda n: value(F.col("channel"), n, dither))
    return rows.withColumn("values", each)


def _positive(channels: int) -> None:
    if int(channels) != channels or channels < 1:
        raise ValueError(f"channel count must be a positive integer, not {channels!r}")
