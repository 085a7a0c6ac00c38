"""The test signal as a source: spark.read.format("signal") and, at a steady rate, spark.readStream.format("signal").

A sample depends on its channel and frame alone, so how a stream is cut into batches changes no value.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..functions import signal
from ..shared import ship

SCHEMA = "frame long, values array<float>"
#: Frames of a task and of an Arrow batch.
TASK_FRAMES, BATCH_FRAMES = 1 << 18, 1 << 13


@dataclass
class Frames(ds.InputPartition):
    first: int
    last: int


class _Samples:
    """channels (32), dither (true), and the frames first (0) to last - 1."""

    def __init__(self, options: dict):
        self.channels = int(options.get("channels", 32))
        self.dither = options.get("dither", "true").lower() != "false"
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    @staticmethod
    def cut(first: int, last: int) -> list[Frames]:
        return [Frames(a, min(last, a + TASK_FRAMES)) for a in range(first, last, TASK_FRAMES)]

    def rows(self, p: Frames) -> Iterator[pa.RecordBatch]:
        for a in range(p.first, p.last, BATCH_FRAMES):
            n = min(BATCH_FRAMES, p.last - a)
            values = np.ascontiguousarray(signal.values(np.arange(self.channels), a, n, self.dither).T, np.float32)
            offsets = pa.array(np.arange(0, (n + 1) * self.channels, self.channels, dtype=np.int32)) if self.channels else pa.array(np.zeros(n + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["frame", "values"])


class SignalReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.samples = _Samples(options)
        if self.samples.last is None:
            raise ValueError("a batch read needs the option `last`")

    def partitions(self):
        return self.samples.cut(self.samples.first, self.samples.last) or [Frames(0, 0)]

    def read(self, partition: Frames):
        yield from self.samples.rows(partition)


class SignalStream(ds.DataSourceStreamReader):
    """rate (4000) frames a second since `begin` (Unix seconds; by default since the stream started), up to `last` where
    that is given. A query that is to be restarted names `begin`, so that the offsets go on from the clock and not from
    zero. The first batch after a start takes all that is due, as Spark asks for it before it says where the query
    stands; later ones take maxframesperbatch frames at most."""

    def __init__(self, options: dict):
        self.samples = _Samples(options)
        self.rate = float(options.get("rate", 4000))
        self.begin = float(options["begin"]) if "begin" in options else time.time()
        self.most = int(options["maxframesperbatch"]) if "maxframesperbatch" in options else None
        self.planned = None  # where the last planned batch ends; Spark may ask for the latest offset more than once a batch

    def initialOffset(self) -> dict:
        self.planned = self.samples.first
        return {"frame": self.samples.first}

    def latestOffset(self) -> dict:
        due = self.samples.first + max(0, int((time.time() - self.begin) * self.rate))
        if self.samples.last is not None:
            due = min(due, self.samples.last)
        if self.planned is not None:
            due = max(self.planned, due if self.most is None else min(due, self.planned + self.most))
        return {"frame": due}

    def partitions(self, start: dict, end: dict):
        self.planned = max(self.planned or 0, end["frame"])
        return self.samples.cut(start["frame"], end["frame"])

    def read(self, partition: Frames):
        yield from self.samples.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class SignalSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType):
        return SignalReader(dict(self.options))

    def streamReader(self, schema: StructType):
        return SignalStream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SignalSource)
