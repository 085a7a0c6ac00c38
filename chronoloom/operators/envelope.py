"""Min/max envelopes, channel statistics, and window geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an envelope at most, and the spread below which a column counts as flat.
MOST_COLUMNS = 4096
FLAT = 1e-7


def known(value: Column) -> Column:
    """NaN marks lost data: it becomes null, since it would be the largest of numbers."""
    return F.when(~F.isnan(value), value)


def grid_bin(frame: Column, start: int, samples_per_column: int) -> Column:
    return F.floor((frame - F.lit(start)) / samples_per_column)


def proportional_bin(index: Column, samples: Column, columns: Column) -> Column:
    """The column c of sample i with floor(c*n/cols) <= i < floor((c+1)*n/cols), for cols <= n."""
    return F.floor(((index + 1) * columns - 1) / samples)


def grid_envelope(samples: DataFrame, start: int, samples_per_column: int, *, keys=("channel",)) -> DataFrame:
    """keys, column, lo, hi of samples(frame, value): bins of a fixed number of samples from `start`; a bin without data is null."""
    v = known(F.col("value"))
    return samples.groupBy(*keys, grid_bin(F.col("frame"), start, samples_per_column).cast("long").alias("column")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def proportional_envelope(samples: DataFrame, start: int, frames: int, columns: int, *, keys=("channel",)) -> DataFrame:
    """The same with `columns` bins that share `frames` samples as evenly as they can."""
    cols = max(1, min(columns, frames))
    v = known(F.col("value"))
    c = proportional_bin(F.col("frame") - start, F.lit(frames), F.lit(cols))
    return samples.groupBy(*keys, c.cast("long").alias("column")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def on_spine(envelope: DataFrame, channels: list[int], columns: int) -> DataFrame:
    """Every channel and column, null where nothing was recorded."""
    spark = envelope.sparkSession
    spine = spark.range(columns).select(F.col("id").alias("column")).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return spine.join(envelope, ["channel", "column"], "left").select("channel", "column", "lo", "hi")


def channel_statistics(samples: DataFrame, *, keys=("channel",)) -> DataFrame:
    """Smallest, largest and root mean square of the recorded values, and how many there are."""
    v = known(F.col("value")).cast("double")
    return samples.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.coalesce(F.sqrt(F.avg(v * v)), F.lit(0.0)).alias("rms"), F.count(v).alias("counted"))


def flat_columns(envelope: DataFrame, *, keys=("channel",)) -> DataFrame:
    return envelope.groupBy(*keys).agg(F.count(F.when(F.col("hi").cast("double") - F.col("lo").cast("double") < FLAT, 1)).alias("flat_columns"))


def auto_fit(samples: DataFrame, *, keys=("channel",)) -> DataFrame:
    """Centre and half height that show all of a channel."""
    s = channel_statistics(samples, keys=keys)
    return s.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("centre"), F.greatest((F.col("hi") - F.col("lo")) / 2, F.lit(1e-6)).alias("half"))


def window_grid(position: int, span: int, columns: int, end: int, live: bool) -> dict[str, int]:
    """Where a moving window of `span` frames begins, aligned to an absolute grid so that columns never shimmer."""
    columns = max(1, min(columns, MOST_COLUMNS))
    per = max(1, math.floor(span / columns + 0.5))
    begin = end - span if live else min(position - span // 2, end - span)
    return {"from": max(0, begin // per * per), "samples_per_column": per, "columns": columns}


def window_grid_column(position: Column, span: Column, columns: Column, end: Column, live: Column) -> Column:
    """The same as a struct column."""
    cols = F.greatest(F.lit(1), F.least(columns, F.lit(MOST_COLUMNS)))
    per = F.greatest(F.lit(1), F.floor(span / cols + F.lit(0.5)))
    begin = F.when(live, end - span).otherwise(F.least(position - F.floor(span / 2), end - span))
    return F.struct(F.greatest(F.lit(0), F.floor(begin / per) * per).cast("long").alias("from"), per.cast("long").alias("samples_per_column"), cols.cast("long").alias("columns"))


def dense_frames(samples: DataFrame, first: int, last: int, channels: list[int]) -> DataFrame:
    """frame, values: one array per frame of [first, last) over `channels`, NaN where nothing was recorded."""
    spark = samples.sparkSession
    at = F.map_from_entries(F.collect_list(F.struct("channel", "value")))
    have = samples.where((F.col("frame") >= first) & (F.col("frame") < last) & F.col("channel").isin(channels)).groupBy("frame").agg(at.alias("m"))
    spine = spark.range(first, last).select(F.col("id").alias("frame"))
    nan = F.lit(float("nan")).cast("float")
    return spine.join(have, "frame", "left").select("frame", F.array(*[F.coalesce(F.element_at("m", F.lit(c)), nan) for c in channels]).alias("values"))


def transposed(frames: DataFrame, block: int) -> DataFrame:
    """Interleaved frames(frame, values) as planar chunks: block_index, channel, start_frame, values in frame order."""
    long = frames.select(F.floor(F.col("frame") / block).alias("block_index"), "frame", F.posexplode("values").alias("channel", "value"))
    chunk = F.array_sort(F.collect_list(F.struct("frame", "value")))
    return long.groupBy("block_index", "channel").agg(F.min("frame").alias("start_frame"), F.transform(chunk, lambda x: x["value"]).alias("values"))
