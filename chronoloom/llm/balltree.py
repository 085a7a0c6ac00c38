"""Centroid clustering over ball trees, in integers.

Each task builds metric trees over its own vectors once: every ball has a centre, a radius, the number of its
vectors and their integer sum. In a round the centroids go down each tree; by the triangle inequality a ball
drops the centroids that can't be nearest to any of its vectors, and when one is left the whole ball is added
to it by count and sum. Otherwise the walk goes on to the leaves, where distances are exact. What leaves the
tasks is a count and sums per centroid, cut into limbs of 32 bits, so that no sum is ever rounded.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import matrix, usable
from ._spark import prepare, save

#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 8192, 64
#: Below this bound of the components all products and sums of 64 components are exact in float64; beyond it Python's integers do the work.
EXACT = 1 << 22
_MOST = 2**63 - 1


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers; scale a power of two."""
    return np.array([[math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in v] for v in vectors.tolist()], dtype=object).reshape(vectors.shape)


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to centroids: float64 where that is exact, else Python integers."""
    small = points.dtype != object and all(abs(int(x)) < EXACT for c in centroids for x in c)
    if small and points.shape[1] <= 64:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.array([((points.astype(object) - c) ** 2).sum(1) for c in centroids], dtype=object).T.reshape(len(points), len(centroids))


class BallTree:
    """Vectors with integer components and the balls over them."""

    def __init__(self, ids: list, points: np.ndarray):
        order = np.arange(len(ids))
        self.begin, self.end, self.left, self.right, self.centre, self.radius, self.sums = [], [], [], [], [], [], []
        stack = [(0, len(ids), -1, False)]
        real = points.astype(np.float64) if points.dtype != object else None
        while stack:
            a, z, parent, is_right = stack.pop()
            node = len(self.begin)
            here = order[a:z]
            self.begin.append(a)
            self.end.append(z)
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            self.sums.append(points[here].astype(object if real is None else np.int64).sum(0))
            if real is None:  # too large for floating-point bounds: one ball without limit
                self.centre.append(np.zeros(points.shape[1]))
                self.radius.append(np.inf)
                continue
            x = real[here]
            centre = x.mean(0)
            far = np.sqrt(((x - centre) ** 2).sum(1))
            same = bool((x == x[0]).all())
            self.centre.append(x[0] if same else centre)
            self.radius.append(0.0 if same else float(far.max()) * (1 + 1e-9) + 1e-6)
            if z - a > LEAF and not same:
                one = x[int(far.argmax())]
                other = x[int(((x - one) ** 2).sum(1).argmax())]
                mid = (z - a) // 2
                order[a:z] = here[np.argpartition(x @ (other - one), mid)]
                stack += [(a, a + mid, node, False), (a + mid, z, node, True)]
        self.ids, self.points = [ids[i] for i in order], points[order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def walk(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """Balls that belong to one centroid as a whole (node, centroid), and leaves with the centroids that may be nearest."""
        c = np.array([[float(max(-(10**300), min(10**300, int(x)))) for x in row] for row in centroids])
        with np.errstate(over="ignore"):
            away = np.sqrt(((self.centre[:, None, :] - c[None, :, :]) ** 2).sum(2))
        whole, leaves = [], []
        stack = [(0, np.arange(len(c)))]
        while stack:
            node, may = stack.pop()
            d, r = away[node, may], self.radius[node]
            with np.errstate(invalid="ignore"):
                lost = d - r > (d.min() + r) * (1 + 1e-9) + 1e-6  # NaN: kept
            may = may[~lost]
            if len(may) == 1:
                whole.append((node, int(may[0])))
            elif self.left[node] < 0:
                leaves.append((node, may))
            else:
                stack += [(self.left[node], may), (self.right[node], may)]
        return whole, leaves

    def _nearest(self, node: int, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _squared(self.points[self.begin[node] : self.end[node]], centroids[may])
        best = np.array([int(np.argmin(row)) for row in d]) if d.dtype == object else d.argmin(1)
        return may[best], d[np.arange(len(d)), best]

    def totals(self, centroids: np.ndarray) -> dict[int, list[int]]:
        """By centroid: the count and the component sums of the vectors nearest to it (ties: the smaller number)."""
        out: dict[int, list[int]] = {}

        def add(k, count, sums):
            now = out.setdefault(k, [0] * (len(sums) + 1))
            for i, x in enumerate((count, *sums.tolist())):
                now[i] += int(x)

        whole, leaves = self.walk(centroids)
        for node, k in whole:
            add(k, self.end[node] - self.begin[node], self.sums[node])
        for node, may in leaves:
            near, _ = self._nearest(node, may, centroids)
            points = self.points[self.begin[node] : self.end[node]]
            points = points if points.dtype == object else points.astype(np.int64)
            for k in np.unique(near).tolist():
                add(k, int((near == k).sum()), points[near == k].sum(0))
        return out

    def assign(self, centroids: np.ndarray) -> tuple[list, np.ndarray, list[int]]:
        """Ids, nearest centroids and squared distances (at most 2^63 - 1) of all vectors."""
        cluster, distance = np.empty(len(self.ids), np.int32), np.empty(len(self.ids), object)
        whole, leaves = self.walk(centroids)
        for node, may in [*((n, np.array([k])) for n, k in whole), *leaves]:
            a, z = self.begin[node], self.end[node]
            cluster[a:z], distance[a:z] = self._nearest(node, may, centroids)
        return self.ids, cluster, [min(_MOST, int(x)) for x in distance]


def _limbs(value: int):
    """(limb, part) with value = sum of part << 32 * limb; all parts within 33 bits."""
    at = 0
    while not -(2**31) <= value < 2**31:
        yield at, value & 0xFFFFFFFF
        value >>= 32
        at += 1
    if value:
        yield at, value


def trees(vectors: DataFrame, *, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """One row per ball tree (pickled), built by each task over its own rows; components become floor(scale * x)."""

    def run(batches):
        small: list[tuple[list, np.ndarray]] = []
        large: list[tuple[list, np.ndarray]] = []
        held = 0

        def made(parts):
            ids, points = [i for p in parts for i in p[0]], np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(BallTree(ids, points), protocol=5)], pa.binary())], ["tree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(matrix(batch.column(1)))
            ids = batch.column(0).to_pylist()
            fits = (np.abs(x) < EXACT // scale - 1).all(1)
            if fits.any():
                small.append(([i for i, f in zip(ids, fits) if f], np.floor(x[fits] * scale).astype(np.int32)))
                held += int(fits.sum())
            if not fits.all():
                large.append(([i for i, f in zip(ids, fits) if not f], _integers(x[~fits], scale)))
                yield made(large)
                large = []
            if held >= TREE:
                yield made(small)
                small, held = [], 0
        if small:
            yield made(small)

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "tree binary")


def _seeds(kept: DataFrame, k: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<id>`: equal ids by their components, rows without id last."""
    rows = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec_id", "embedding").limit(k).collect()
    return _integers(np.array([r["embedding"] for r in rows], np.float64), scale) if rows else np.empty((0, 0), object)


def clusters(vectors: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with exactly `width` usable components.

    Components become integers floor(scale * x). The centroids start as `_seeds` and move `rounds` times to the floor of
    their vectors' mean; a centroid without vectors stays; then all vectors are assigned once more. All of it is exact;
    distances and inertias beyond 64 bits come back as 2^63 - 1. Vectors that are null, of another length or hold null or
    non-finite components take no part; repeated ids are vectors of their own, and so are rows without id. With fewer than k
    vectors there are as many centroids as vectors; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = kept.where(usable(F.col("embedding")) & (F.size("embedding") == width))
    forest = save(trees(kept, scale=scale, id_col="vec_id", vector_col="embedding"), "ball-trees")
    centroids = _seeds(kept, k, scale)

    for _ in range(rounds):

        def totals(batches, centroids=centroids):
            all_: dict[int, list[int]] = {}
            for batch in batches:
                for tree in batch.column(0):
                    for c, sums in pickle.loads(tree.as_py()).totals(centroids).items():
                        now = all_.setdefault(c, [0] * len(sums))
                        all_[c] = [a + b for a, b in zip(now, sums)]
            rows = [(c, i, limb, part) for c, sums in all_.items() for i, s in enumerate(sums) for limb, part in _limbs(s)]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))] if rows else []
            if cols:
                yield pa.RecordBatch.from_arrays(cols, ["cluster", "at", "limb", "part"])

        summed = forest.mapInArrow(totals, "cluster int, at int, limb int, part long").groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part"))
        got: dict[int, list[int]] = {}
        for r in summed.collect():  # at most k * (width + 1) sums, each of a few limbs
            got.setdefault(r["cluster"], [0] * (width + 1))[r["at"]] += r["part"] << (32 * r["limb"])
        centroids = centroids.copy()
        for c, (count, *sums) in got.items():
            centroids[c] = np.array([s // count for s in sums], dtype=object)

    def assigned(batches, centroids=centroids):
        for batch in batches:
            for tree in batch.column(0):
                ids, cluster, distance = pickle.loads(tree.as_py()).assign(centroids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = save(forest.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # at most k rows
    total = sum(sums.values())
    per = [(c, min(_MOST, s), min(_MOST, total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    named = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
