"""Exact top-k inner-product search: one KD-tree per shard.

A tree splits at the median of its widest axis and keeps the tight bounding box of every node. A query
walks a tree best box first, by the largest inner product that a point of the box can reach, and stops
when that falls below the kth score so far. A query searches its own shard first; the kth score it finds
there goes with it to all other shards, so that they start with a bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._shards import by_length, counted, dealt, matrix, over_shards, placed, repeated, shard_count, usable
from ._spark import prepare, save

#: Points of a leaf at most.
LEAF = 128


class KDTree:
    """Points with integer components, for exact inner products; copies says how many rows a point stands for (1 each by default)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, copies: np.ndarray | None = None):
        order = np.arange(len(ids))
        self.lo, self.hi, self.left, self.right, self.begin, self.end = [], [], [], [], [], []
        stack = [(0, len(ids), None, False)]
        while stack:
            a, z, parent, is_right = stack.pop()
            here = order[a:z]
            block = points[here]
            node = len(self.lo)
            self.lo.append(block.min(0))
            self.hi.append(block.max(0))
            self.begin.append(a)
            self.end.append(z)
            self.left.append(-1)
            self.right.append(-1)
            if parent is not None:
                (self.right if is_right else self.left)[parent] = node
            spread = self.hi[node] - self.lo[node]
            if z - a > leaf and spread.max() > 0:
                axis, mid = int(spread.argmax()), (z - a) // 2
                order[a:z] = here[np.argpartition(block[:, axis], mid)]
                stack += [(a, a + mid, node, False), (a + mid, z, node, True)]
        self.ids, self.points, self.rows = ids[order], points[order], order
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.largest = float(np.abs(points).max()) if len(points) else 0.0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[list[int], list[int]]]:
        """For each query the ids and scores of its k best, none below its floor (NaN: no floor).

        own is the query's own row among those the tree was built of (-1: it is in none), which is no candidate.
        Products and their sums below 2^53 are exact in float64; beyond that Python's integers do the work.
        Scores beyond 64 bits come back as the nearest 64-bit integer.
        """
        exact = self.largest * (float(np.abs(queries).max()) if len(queries) else 0.0) * max(1, self.points.shape[1]) < 2.0**53
        return [self._one(queries[i], own[i], k, floors[i], exact) for i in range(len(queries))]

    def _reach(self, pos, neg, nodes, exact):
        """The largest products that points of these nodes' boxes can have with a query (its positive and negative part)."""
        out = self.hi[nodes] @ pos + self.lo[nodes] @ neg
        return out if exact else out + np.abs(out) * 1e-9 + 1.0

    def _one(self, q, own, k, floor, exact):
        """Best box first; a box's bound is taken when its parent is opened. Scores are compared as exact integers;
        only bounds are rounded, upwards."""
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        kth = -np.inf if np.isnan(floor) else floor
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        heap = [(-float(self._reach(pos, neg, [0], exact)[0]), 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            if self.left[node] >= 0:
                children = [self.left[node], self.right[node]]
                for child, reach in zip(children, self._reach(pos, neg, children, exact).tolist()):
                    if reach >= kth:
                        heapq.heappush(heap, (-reach, child))
                continue
            a, z = self.begin[node], self.end[node]
            ids, times = self.ids[a:z], np.minimum(self.copies[a:z] - (self.rows[a:z] == own), k)
            if exact:
                score = self.points[a:z] @ q
                keep = np.flatnonzero((score >= kth) & (times > 0))
                keep = np.repeat(keep, times[keep])
                new = list(zip((-score[keep]).astype(np.int64).tolist(), ids[keep].tolist()))
            else:
                qi = [int(x) for x in q]
                new = [(-sum(int(x) * y for x, y in zip(p, qi)), i) for p, i, n in zip(self.points[a:z].tolist(), ids.tolist(), times.tolist()) for _ in range(n)]
            if new:
                best = heapq.nsmallest(k, best + new)
                if len(best) == k:
                    kth = max(kth, float(-best[-1][0]))
        return [i for _, i in best], [max(-(2**63), min(2**63 - 1, -s)) for s, _ in best]


def _build(ids, vectors, copies):
    parts = by_length(ids, [np.floor(256.0 * v) for v in vectors], copies)
    return {d: (KDTree(i, x, copies=n), i, x, n) for d, (i, x, n) in parts.items()}


def _hits(rows: list) -> pa.Array:
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))
    return pa.array([[{"vec_id": a, "score": b} for a, b in zip(*r)] for r in rows], kind)


def top_inner_products(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every row whose id is a multiple of `every`.

    Components become floor(256 * x). Null ids and unusable vectors, also those with a component beyond 7e305, take no part; vectors
    meet only vectors of their own length; ties go to the smaller id. Rows that repeat an id, or an id and its vector, all count:
    each is a candidate of all others, and each asks on its own. An empty table, or a query without candidates, gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    # Where 256 * x overflows, the component has no finite value.
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & ~F.exists("embedding", lambda x: F.abs(x) > 7e305))
    v = save(counted(v), "topk-rows")
    shards = shard_count(v.count())
    v = placed(v, shards)

    def at_home(batches):
        def rows(index, shard, batch):
            asked, ids, many, vecs, hits, kth = [], [], [], [], [], []
            for tree, own, x, copies in index.values():
                mine = np.flatnonzero(own % every == 0)
                found = tree.search(x[mine], mine, k, np.full(len(mine), np.nan))
                for i, f in zip(mine, found):
                    asked.append((shard << 40) + len(asked))
                    ids.append(int(own[i]))
                    many.append(int(copies[i]))
                    vecs.append(x[i].tolist())
                    hits.append(f)
                    kth.append(f[1][-1] if len(f[1]) == k else None)
            return pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(ids, pa.int64()), pa.array(many, pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array([shard] * len(ids), pa.int32()), pa.array(kth, pa.int64()), _hits(hits)], ["asked", "query_id", "many", "q", "home", "kth", "hits"])

        # One closing row per shard asks for the search of its own queries.
        yield from over_shards(batches, _build, rows)

    close = spark.range(shards).select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(1).cast("long").alias("copies"), F.col("id").cast("int").alias("shard"), F.lit(1).alias("kind"))
    stream = dealt(v.withColumn("kind", F.lit(0)).unionByName(close), shards)
    home = save(stream.mapInArrow(at_home, "asked long, query_id long, many long, q array<double>, home int, kth long, hits array<struct<vec_id:long,score:long>>"), "topk-home")

    def elsewhere(batches):
        def rows(index, shard, batch):
            floors = np.array([np.nan if x is None else float(x) for x in batch.column("kth").to_pylist()])
            q = matrix(batch.column("embedding"))
            hits = [([], [])] * len(q)
            for d, (tree, *_) in index.items():
                mine = [i for i in range(len(q)) if len(q[i]) == d]
                if mine:
                    for i, f in zip(mine, tree.search(np.array([q[i] for i in mine]), np.full(len(mine), -1), k, floors[mine])):
                        hits[i] = f
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("asked", "vec_id", "many")), _hits(hits)], ["asked", "query_id", "many", "hits"])

        yield from over_shards(batches, _build, rows)

    # A row's own shard is done: in the others every row is a candidate.
    asked = home.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.col("home"))
    asked = asked.select(F.col("query_id").alias("vec_id"), F.col("q").alias("embedding"), F.lit(1).cast("long").alias("copies"), "shard", F.lit(1).alias("kind"), "kth", "asked", "many")
    none = F.lit(None).cast("long")
    stream = dealt(v.withColumns({"kind": F.lit(0), "kth": none, "asked": none, "many": none}).unionByName(asked), shards)
    far = stream.mapInArrow(elsewhere, "asked long, query_id long, many long, hits array<struct<vec_id:long,score:long>>")
    found = home.select("asked", "query_id", "many", "hits").unionByName(far).select("asked", "query_id", "many", F.inline("hits"))
    best = W.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return repeated(found, "many").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
