"""Ball-tree clustering against plain integer clustering."""

import hashlib
import math

import numpy as np
import pytest

from chronoloom.llm import balltree
from chronoloom.llm.balltree import BallTree, _limbs, clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k, rounds, width, scale):
    kept = []
    for i, v in rows:
        if v is None or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in v], v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[2]))
    c = [list(r[1]) for r in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        got = [near(q)[1] for _, q, _ in kept]
        for j in range(len(c)):
            mine = [q for (_, q, _), g in zip(kept, got) if g == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(q) for _, q, _ in kept]
    most = 2**63 - 1
    each = {j: sum(min(most, d) for d, g in last if g == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(repr((i, g, min(most, d), min(most, each[g]), min(most, sum(each.values())), sha[g])) for (i, _, _), (d, g) in zip(kept, last))


def view(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("spread", [0.0, 0.05, 3.0])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5)) * 2
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=5)).tolist()) for i in range(900)]
    assert view(clusters(frame(spark, rows), k=7, width=5)) == brute(rows, 7, 3, 5, 64)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(None, [0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0]), (5, [0.1, 0.2, 0.3]), (5, [-0.1, 0.2, 0.3]), (201, None), (202, []), (203, [1.0, 2.0]), (204, [1.0, None, 1.0]), (205, [1.0, float("nan"), 1.0]), (206, [float("inf"), 1.0, 1.0])]
    rows += [(300 + i, [0.25, 0.25, 0.25]) for i in range(150)]  # copies, a third of all
    assert view(clusters(frame(spark, rows), k=16, width=3)) == brute(rows, 16, 3, 3, 64)


def test_beyond_64_bits(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=2) * 10.0 ** rng.integers(0, 300)).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=2).tolist()) for i in range(60)] + [(999, [1.7e308, -1.7e308])]
    assert view(clusters(frame(spark, rows), k=4, width=2)) == brute(rows, 4, 3, 2, 64)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0])]
    assert view(clusters(frame(spark, rows), k=16, width=2)) == brute(rows, 16, 3, 2, 64)
    assert clusters(frame(spark, rows).where("false"), width=2).collect() == []


def test_balls_are_assigned_whole(monkeypatch):
    monkeypatch.setattr(balltree, "LEAF", 8)
    rng = np.random.default_rng(10)
    points = np.concatenate([rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (400, 4)) + 5000]).astype(np.int32)
    tree = BallTree(list(range(800)), points)
    centroids = np.array([[0] * 4, [5000] * 4, [20000] * 4], dtype=object)
    whole, leaves = tree.walk(centroids)
    assert sum(tree.end[n] - tree.begin[n] for n, _ in whole) == 800 and len(whole) <= 3 and not leaves
    totals = tree.totals(centroids)
    assert totals[0] == [400, *points[:400].astype(int).sum(0)] and totals[1] == [400, *points[400:].astype(int).sum(0)]
    near = np.array([[1] * 4, [2] * 4], dtype=object)  # two centroids inside one ball: leaves decide
    assert sum(v[0] for v in tree.totals(near).values()) == 800


def test_limbs():
    for v in (0, 1, -1, 2**31, -(2**31) - 1, 2**200 + 17, -(2**200) - 17):
        assert sum(p << (32 * at) for at, p in _limbs(v)) == v and all(abs(p) < 2**33 for _, p in _limbs(v))
