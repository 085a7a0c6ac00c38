"""A Parquet index of block headers over any number of recordings: ranges of frames by a join, not by opening files.

The index has a row for every sound block (path, place of its payload, frames). Ranges are joined with it over
buckets of frame numbers, and tasks then read just the blocks that were hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship
from . import recording
from .files import locate

#: Frames of a bucket of the join.
BUCKET = 1 << 16
_SAMPLES = "range_id long, recording_id string, block_index long, frame long, channel int, value float"


def build(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the index of a recording, or of all in a folder, sorted by frame within its files; and reads it."""
    rows = recording.read(spark, path, "index")
    rows.sortWithinPartitions("start_frame").write.parquet(out)
    return spark.read.parquet(out)


def hits(index: DataFrame, ranges: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """The index's rows once for each of ranges(range_id, low, high) whose frames low..high - 1 they touch, with low and high.

    Both sides go to the buckets they reach into, a block to few and a range to as many as it is long; a pair counts in the
    first bucket they share. Null or empty ranges hit nothing.
    """
    spread = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(z) - 1) / bucket)))
    r = ranges.select(F.col("range_id").cast("long").alias("range_id"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).where("low < high").withColumn("low", F.greatest("low", F.lit(0)))
    ends = index.agg(F.min("start_frame").alias("a"), F.max("end_frame").alias("z"))  # one row: long ranges stop where the recordings do
    r = r.join(F.broadcast(ends)).withColumns({"from": F.greatest("low", "a"), "to": F.least("high", "z")}).where("from < to")
    r = r.withColumn("bucket", spread("from", "to")).drop("from", "to", "a", "z")
    b = index.where("start_frame < end_frame").withColumn("bucket", spread("start_frame", "end_frame"))
    both = b.join(r, "bucket").where("start_frame < high AND end_frame > low")
    return both.where(F.col("bucket") == F.floor(F.greatest("start_frame", "low") / bucket)).drop("bucket")


def samples(index: DataFrame, ranges: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """range_id, recording_id, block_index, frame, channel, value of all frames of the ranges, of the given channels.

    A task opens a file only for blocks that were hit, and reads one run of bytes per block and channel.
    """
    spark = index.sparkSession
    ship(spark)

    def run(batches):
        uri, file = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != uri:
                    fs, path = locate(r["path"])
                    uri, file = r["path"], fs.open_input_file(path)
                a, z, n = max(r["low"], r["start_frame"]), min(r["high"], r["end_frame"]), r["end_frame"] - r["start_frame"]
                for c in range(r["channel_count"]) if channels is None else [c for c in channels if 0 <= c < r["channel_count"]]:
                    data = file.read_at((z - a) * 4, r["payload_offset"] + (c * n + a - r["start_frame"]) * 4)
                    same = lambda x, t: pa.array(np.full(z - a, x), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(r["range_id"], pa.int64()), pa.array([r["recording_id"]] * (z - a)), same(r["block_index"], pa.int64()), pa.array(np.arange(a, z)), same(c, pa.int32()), pa.array(np.frombuffer(data, "<f4"))], [x.split()[0] for x in _SAMPLES.split(", ")])

    tasks = max(1, spark.sparkContext.defaultParallelism)
    spread = hits(index, ranges).repartition(tasks, "path", F.floor(F.col("block_index") / 16)).sortWithinPartitions("path", "block_index")
    return spread.mapInArrow(run, _SAMPLES)
