"""Timing statistics: log-scaled lag histograms, pacing reports, buffer levels, playback segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import chains
from .ordered import CHUNK, previous, running, unused

BUCKETS = 64


def lag_bucket(micros: Column) -> Column:
    """0 below one microsecond, else the number of binary digits of its whole part."""
    return F.when(micros < 1, F.lit(0)).otherwise(F.least(F.lit(BUCKETS - 1), F.char_length(F.bin(F.floor(micros))))).cast("int")


def lag_histogram(lags: DataFrame, micros: Column) -> DataFrame:
    return lags.groupBy(lag_bucket(micros).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantiles(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """q, upper_us: the upper bound of the first bucket whose cumulative count reaches q of all. At most 64 rows are windowed."""
    w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = histogram.select("bucket", F.sum("n").over(w).alias("cum"), F.sum("n").over(W.partitionBy()).alias("total"))
    h = h.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).where(F.col("cum") >= F.col("total") * F.col("q"))
    return h.groupBy("q").agg(F.min("bucket").alias("b")).select("q", F.pow(F.lit(2.0), "b").cast("long").alias("upper_us"))


def lag_summary(lags: DataFrame, micros: Column) -> DataFrame:
    """samples, mean and max (one decimal)."""
    return lags.agg(F.count(micros).alias("samples"), F.round(F.avg(micros), 1).alias("mean_us"), F.round(F.max(micros), 1).alias("max_us"))


def tick_lags(ticks: DataFrame, tick_ns: int, *, start_ns: int = 0) -> DataFrame:
    """ticks(k, now_ns): lag of each tick behind its absolute deadline in microseconds, where it is late at all."""
    lag = (F.col("now_ns") - F.lit(start_ns) - F.col("k") * tick_ns) / F.lit(1000.0)
    return ticks.withColumn("lag_us", lag).where(F.col("lag_us") > 0)


def due_ticks(ticks: DataFrame, tick_ns: int, *, start_ns: int = 0, catch_up: int = 40) -> DataFrame:
    """wake-ups(k: next tick, now_ns): ticks due, how many are late, how many are made up, and how many are given up."""
    due = F.greatest(F.lit(0), F.floor((F.col("now_ns") - start_ns) / tick_ns) - F.col("k") + 1)
    return ticks.withColumn("due", due).withColumns({"late": F.greatest(F.lit(0), F.col("due") - 1), "emitted": F.least(F.col("due"), F.lit(catch_up)), "skipped": F.greatest(F.lit(0), F.col("due") - catch_up)})


def frames_per_tick(rate: Column, tick_ns: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(rate.cast("double") * tick_ns / F.lit(1e9) + F.lit(0.5))).cast("long")


def pacing_report(clock: DataFrame, rate: float) -> DataFrame:
    """clock(at_ns, frame): frames emitted and expected over the elapsed time, their deviation, and parts per million."""
    r = clock.agg((F.max("at_ns") - F.min("at_ns")).alias("elapsed_ns"), F.count("*").alias("emitted"))
    r = r.withColumn("expected", F.floor(F.col("elapsed_ns").cast("decimal(38,0)") * math.floor(rate + 0.5) / F.lit(1_000_000_000)).cast("long"))
    r = r.withColumn("deviation", F.col("emitted") - F.col("expected"))
    return r.withColumn("deviation_ppm", F.when(F.col("expected") > 0, F.round(F.col("deviation") / F.col("expected") * 1e6, 3)).otherwise(F.lit(0.0)))


def buffer_levels(fills: DataFrame, capacity: float, *, order=("seq",), keys=(), chunk: int = CHUNK) -> DataFrame:
    """Adds level to fills(used): HIGH from 75 %, NORMAL below 25 %; in between HIGH holds on, else ELEVATED."""
    part = F.col("used") / F.lit(float(capacity))
    definite = F.when(part >= 0.75, F.lit("HIGH")).when(part < 0.25, F.lit("NORMAL"))
    (sure,) = unused(fills.columns, "sure")
    f = running(fills, "last", definite, sure, order=list(order), keys=list(keys), chunk=chunk)
    return f.withColumn("level", F.coalesce(definite, F.when(F.col(sure) == "HIGH", F.lit("HIGH")).otherwise(F.lit("ELEVATED")))).drop(sure)


def level_changes(levels: DataFrame, *, order=("seq",), keys=(), chunk: int = CHUNK) -> DataFrame:
    """Rows whose level differs from the one before; the state before the first is NORMAL."""
    (was,) = unused(levels.columns, "was")
    p = previous(levels, F.col("level"), was, order=list(order), keys=list(keys), chunk=chunk)
    return p.where(F.col("level") != F.coalesce(was, F.lit("NORMAL"))).drop(was)


def playback_segments(commands: DataFrame, *, rate: float, stop_us: int, chunk: int = 3_600_000_000) -> DataFrame:
    """Commands(at_us, playing, speed) as segments up to the next command: emitted and expected frames, and the allowed deviation.

    Of commands at one time, those that stop come first, then slower ones; all but the last last for no time.
    """
    # Read backwards, the next command is the last one before.
    c = commands.select("at_us", "playing", F.col("speed").cast("double").alias("speed"), (-F.col("at_us")).alias("back"), (~F.col("playing")).alias("stops"), (-F.col("speed")).alias("slow"))
    c = previous(c, F.col("at_us"), "until_us", order=["back", "stops", "slow"], chunk=chunk)
    c = c.withColumn("until_us", F.coalesce("until_us", F.lit(stop_us))).where("playing")
    c = c.withColumn("elapsed_us", F.col("until_us") - F.col("at_us"))
    return c.withColumns({"expected": F.floor(F.col("elapsed_us") / F.lit(1e6) * F.lit(float(rate)) * F.col("speed")).cast("long"), "bound": frames_per_tick(F.lit(float(rate)) * F.col("speed"), F.lit(5_000_000))}).select("at_us", "until_us", "speed", "elapsed_us", "expected", "bound")


def emit_schedule(frames: DataFrame, first: int, rate: float, speed: float, start_us: int = 0) -> DataFrame:
    """When each frame of a playback is due."""
    return frames.withColumn("due_us", F.lit(start_us) + F.floor((F.col("frame") - first) * F.lit(1e6) / F.lit(float(rate) * float(speed)) + F.lit(0.5)).cast("long"))


def throttled(log: DataFrame, interval_ms: int, *, keys=("event",), chunk: int | None = None) -> DataFrame:
    """log(event, at_ms): lines at least interval_ms after the last line let through of the same event.

    A line that passes names the next one that does: the first at least interval_ms later. These chains are followed over
    chunks of time (see chains.followed), as wide as the log's density allows unless `chunk` says so, and no task gets an event
    as a whole. Of lines of one event and time one passes;
    lines without a time don't. interval_ms must be positive.
    """
    if interval_ms <= 0:
        raise ValueError("the interval must be positive")
    key, node = unused(log.columns, "key", "node")
    named = log.where(F.col("at_ms").isNotNull()).withColumns({key: F.to_json(F.struct(*keys)), node: F.col("at_ms").cast("long")})
    nodes = named.select(F.col(key).alias("key"), F.col(node).alias("node")).distinct()
    if chunk is None:
        chunk = chains.width(nodes)
    begin = nodes.groupBy("key").agg(F.min("node").alias("begin"))
    chained = chains.first_from(nodes, F.col("node") + interval_ms, chunk=chunk).join(begin, "key")
    kept = chains.followed(chained.select("key", "node", "next", (F.col("node") == F.col("begin")).alias("root")), chunk=chunk)
    kept = kept.select(F.col("key").alias(key), F.col("node").alias(node))
    return named.join(kept, [key, node], "left_semi").dropDuplicates([key, node]).select(*log.columns)


def schedule(wakes: DataFrame, tick_ns: int, rate: float, *, start_ns: int = 0, start_frame: int = 0, catch_up: int = 40, order=("seq",), keys=(), chunk: int = CHUNK) -> DataFrame:
    """Adds to wake-ups(now_ns) of a scheduler with absolute deadlines what each does: tick (the next one before it), behind,
    late, emitted, first_frame and frame_count (what it emits), and resync_start and resync_frames (what it gives up, by position).

    A wake-up takes all ticks that are due, so the next tick is the largest number of ticks that was ever due: a running
    maximum instead of a fold. An early wake-up, or one after the clock went back, does nothing.
    """
    per = max(1, math.floor(rate * tick_ns / 1e9 + 0.5))
    due = F.expr(f"(now_ns - {int(start_ns)} - pmod(now_ns - {int(start_ns)}, {int(tick_ns)})) div {int(tick_ns)}") + 1
    w = running(wakes, "max", due, "tick", order=list(order), keys=list(keys), before=True, chunk=chunk)
    w = w.withColumn("tick", F.greatest(F.coalesce("tick", F.lit(0)), F.lit(0)).cast("long"))
    w = w.withColumn("behind", F.greatest(F.lit(0), due - F.col("tick")).cast("long"))
    skipped = F.greatest(F.lit(0), F.col("behind") - catch_up)
    w = w.withColumns({"late": F.greatest(F.lit(0), F.col("behind") - 1), "emitted": F.least(F.col("behind"), F.lit(catch_up)).cast("long"), "resync_frames": (skipped * per).cast("long")})
    at = F.lit(start_frame) + F.col("tick") * per
    return w.withColumns({"resync_start": F.when(F.col("resync_frames") > 0, at), "first_frame": F.when(F.col("emitted") > 0, at + F.col("resync_frames")), "frame_count": F.col("emitted") * per})


def schedule_totals(scheduled: DataFrame) -> DataFrame:
    """One row: ticks, frames, late_ticks, resync_count, resync_frames."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return scheduled.agg(s("emitted").alias("ticks"), s("frame_count").alias("frames"), s("late").alias("late_ticks"), F.count(F.when(F.col("resync_frames") > 0, 1)).alias("resync_count"), s("resync_frames").alias("resync_frames"))


def playback_totals(segments: DataFrame) -> DataFrame:
    """One row over playback segments(speed, elapsed_us, emitted, expected, bound): sums, the largest deviation, and whether
    the deviation stays within the summed bounds."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = segments.agg(F.count("*").alias("segments"), s("elapsed_us").alias("elapsed_us"), s("emitted").alias("emitted"), s("expected").alias("expected"), s("bound").alias("bound"), F.coalesce(F.max(F.abs(F.col("emitted") - F.col("expected"))), F.lit(0)).alias("largest_deviation"), F.max("speed").alias("fastest"))
    return t.withColumn("deviation", F.col("emitted") - F.col("expected")).withColumn("within", F.abs("deviation") <= F.col("bound"))


def pacing_text(report: DataFrame) -> DataFrame:
    """A pacing_report row as JSON and as lines of text."""
    lines = F.concat_ws(
        "\n", F.format_string("elapsed      %.3f s", F.col("elapsed_ns") / F.lit(1e9)), F.format_string("emitted      %d frames", "emitted"),
        F.format_string("expected     %d frames", "expected"), F.format_string("deviation    %d frames (%.3f ppm)", F.col("deviation"), F.col("deviation_ppm").cast("double")),
    )
    return report.withColumns({"json": F.to_json(F.struct(*report.columns)), "text": lines})
