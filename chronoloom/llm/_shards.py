"""Vectors in shards: a stream that hands each shard's rows, then its queries, to a search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard at most (on average; hashing spreads them evenly).
SHARD_ROWS = 65536
#: Small tables are cut too, into at most so many shards of at least so many rows, for the sake of more tasks.
SMALL_SHARDS, LEAST_ROWS = 16, 1024


def usable(vector: Column) -> Column:
    """Neither null nor empty, nor holding null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def shard_count(rows: int) -> int:
    """By the rows alone: results don't change with the cluster."""
    return max(1, -(-rows // SHARD_ROWS), min(SMALL_SHARDS, -(-rows // LEAST_ROWS)))


def counted(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, copies: rows that are the same in both are counted before they travel on, so none of them crowd a shard."""
    return vectors.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))


def placed(vectors: DataFrame, shards: int) -> DataFrame:
    """Adds the shard of each row, by a hash of its id and vector: rows that share an id alone spread."""
    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column `copies` says, without that column; numbers unfold in two steps, so that no long list arises."""
    many, block = F.col(copies), 4096
    rows = rows.withColumn(copies, F.explode(F.transform(F.sequence(F.lit(0), F.floor((many - 1) / block)), lambda b: F.least(F.lit(block), many - b * block).cast("int"))))
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """A shard per partition, its vectors before its queries."""
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")


def matrix(column: pa.Array) -> list[np.ndarray]:
    """One float64 vector per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    off = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def by_length(ids: np.ndarray, vectors: list[np.ndarray], copies: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ids, their matrix and their numbers of copies, in the order of ids and vectors whatever order the rows come in."""
    out: dict[int, list[int]] = {}
    shared, times = np.unique(ids, return_counts=True)
    shared = set(shared[times > 1].tolist())
    for i in sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i].tolist() if ids[i] in shared else ())):
        out.setdefault(len(vectors[i]), []).append(i)
    return {d: (ids[own], np.array([vectors[i] for i in own]), copies[own]) for d, own in out.items()}


def over_shards(batches: Iterator[pa.RecordBatch], build: Callable, search: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): build(ids, vectors, copies) of a shard's kind 0, then search(index, shard, batch) of its kind 1."""
    shard, ids, vecs, copies, index = None, [], [], [], None
    for batch in batches:
        s = batch.column("shard").to_numpy(zero_copy_only=False)
        k = batch.column("kind").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(s)] if len(s) else [0]
        for a, z in zip(cut, cut[1:]):
            if s[a] != shard:
                shard, ids, vecs, copies, index = s[a], [], [], [], None
            part = batch.slice(a, z - a)
            if k[a] == 0:
                ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
                vecs += [v.copy() for v in matrix(part.column("embedding"))]
                copies.append(part.column("copies").to_numpy(zero_copy_only=False))
            else:
                if index is None:
                    none = np.empty(0, np.int64)
                    index = build(np.concatenate([none, *ids]), vecs, np.concatenate([none, *copies]))
                    ids, vecs, copies = [], [], []
                yield search(index, int(shard), part)
