"""A streaming sink for blocks: every micro-batch once, whatever is run again.

Tasks write their rows to part files of names of their own. What counts is a batch's manifest, which names its part
files and appears as a whole, under the batch's number: a batch that is run again after a failure finds the
manifest of its first run, and its own files go. Parts that no manifest names were never committed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from . import assembly
from .files import locate


@dataclass
class Part(ds.WriterCommitMessage):
    """A part file and its rows; no file for no rows."""

    name: str | None
    rows: int


class BlockSink(ds.DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> Part:
        fs, folder = locate(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(f"{folder}/parts", recursive=True)
                out = pq.ParquetWriter(fs.open_output_stream(f"{folder}/parts/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Part(None, 0)
        out.close()
        return Part(name, rows)

    def _manifest(self, batch: int) -> str:
        return f"{locate(self.path)[1]}/commits/{batch:020d}.json"

    def commit(self, messages, batchId: int) -> None:
        fs, folder = locate(self.path)
        name = self._manifest(batchId)
        if fs.get_file_info(name).type == pafs.FileType.File:
            self._drop(messages)
            return
        fs.create_dir(f"{folder}/commits", recursive=True)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps({"batch": batchId, "parts": parts}).encode())
        fs.move(f"{name}.tmp", name)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)

    def _drop(self, messages) -> None:
        fs, folder = locate(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{folder}/parts/{m.name}")


def batches(path: str) -> list[dict]:
    """The committed batches and their parts, in order."""
    fs, folder = locate(path.rstrip("/"))
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{folder}/commits", allow_not_found=True)) if f.path.endswith(".json")]
    return [json.loads(fs.open_input_stream(f).read()) for f in sorted(found)]


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches."""
    names = [f"{path.rstrip('/')}/parts/{p['name']}" for b in batches(path) for p in b["parts"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def finalise(spark: SparkSession, path: str, folder: str, schema: str, **options) -> list[dict]:
    """One recording per stream of the sink's committed blocks, each written in parallel (see assembly.assemble); their totals.

    A stream's file is named after it, with every byte but letters, digits, - and _ written as %XX.
    """
    blocks = committed(spark, path, schema)
    out = []
    for row in blocks.select("stream").distinct().orderBy("stream").collect():
        own = blocks.where(F.col("stream").eqNullSafe(row["stream"])).drop("stream")
        out.append({"stream": row["stream"]} | assembly.assemble(own, f"{folder.rstrip('/')}/{_name(row['stream'])}.sigb", **options))
    return out


def _name(stream: str | None) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "".join(f"%{b:02X}" for b in c.encode()) for c in stream) if stream is not None else "%"

