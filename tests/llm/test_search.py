"""Top-k and graph search against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm.graphann import SEARCH_BEAM, Graph, nearest
from chronoloom.llm.topk import KDTree, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, k, every):
    good = []
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) or abs(x) > 7e305 for x in v):
            continue
        good.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(good) if j != at and len(b) == len(a))[:k]
            out.update((q, r + 1, i, -score) for r, (score, i) in enumerate(s))
    return out


def test_topk_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(1).astype(float).tolist()) for i in range(3000)]
    rows += [(None, [1.0] * 8), (3000, None), (3050, []), (3100, [1.0, None] + [0.0] * 6), (3150, [float("nan")] * 8), (3200, [float("inf")] * 8)]
    rows += [(50, rows[50][1]), (100, rows[7][1]), (5000, [0.5, 0.25]), (5050, [0.5, -0.25]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = Counter(tuple(r) for r in top_inner_products(df, k=5, every=50).collect())
    assert got == brute_topk(rows, 5, 50)
    assert top_inner_products(df.where("vec_id < 0"), k=5).count() == 0


def test_topk_ties_and_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(120)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumn("score", F.lit(1))
    got = Counter(tuple(r) for r in top_inner_products(df, k=5, every=50).collect())
    assert got == brute_topk(rows, 5, 50)


def test_rows_of_one_id_all_count(spark):
    # Two thirds of the rows share an id: some with vectors of their own, and 5,000 the same one.
    rng = np.random.default_rng(5)
    rows = [(100, [1.0, 0.5, 0.25])] * 5000 + [(100, rng.standard_normal(3).round(2).tolist()) for _ in range(20)] + [(i, rng.standard_normal(3).round(2).tolist()) for i in range(1, 90)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    few = rows[:8] + rows[5000:]  # more copies than places change nothing but how often they ask
    want = brute_topk(few, 5, 50)
    got = Counter(tuple(r) for r in top_inner_products(df, k=5, every=50).collect())
    assert set(got) == set(want) and sum(got.values()) == 5 * (5020 + 1)
    near = nearest(df, k=10, every=100).collect()
    assert len(near) == 10 * 5020 and sum(r["score"] == 0 for r in near) == 50_000
    pair = spark.createDataFrame([(1, [0.1, 0.2], 0), (1, [0.9, 0.9], 0), (50, [1.0, 1.0], 0)], SCHEMA)
    assert [tuple(r)[:3] for r in top_inner_products(pair, k=5, every=50).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 1)]


def test_topk_of_huge_doubles(spark):
    rows = [(0, [1e306, 1.0]), (50, [7e305, 1.0]), (51, [-2.0, 0.5]), (52, [1e-300, 3.0])]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(50, 52), (50, 51)]


def test_tree_beyond_double_precision():
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((300, 4)) * 1e9)
    tree = KDTree(np.arange(300), x, leaf=16)
    ids, scores = tree.search(x[:1], np.array([0]), 3, np.array([np.nan]))[0]
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(x[0], y)), i) for i, y in enumerate(x) if i)[:3]
    assert ids == [i for _, i in exact] and scores == [-s for s, _ in exact]


def test_graph_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(4001, [0.0] * 32, 0), (4002, None, 0), (4100, [float("nan")] * 32, 0)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=10, every=100).collect()
    d = x.astype(float)
    hits = 0
    for q in range(0, 4000, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = set(np.argsort(dist)[:10].tolist())
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 11))
        assert all(abs(r["score"] - dist[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len(best & {r["vec_id"] for r in mine})
    assert hits / 400 >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 4000, 100))


def test_graph_recall_on_a_larger_shard():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((16_000, 64)).astype(np.float32).astype(float)
    graph, asked = Graph(np.arange(len(x)), x), np.arange(0, 16_000, 100)
    found = graph.search(x[asked], asked, 10, SEARCH_BEAM)
    hits = 0
    for q, (ids, _) in zip(asked, found):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & set(ids))
    assert hits / (10 * len(asked)) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 5])
def test_graph_with_few_points(spark, n):
    rows = [(100 * i, [float(i), 1.0], 0) for i in range(n)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=10, every=100).collect()
    assert len(got) == n * (n - 1)


def test_graph_of_copies():
    g = Graph(np.arange(500), np.ones((500, 3)))
    ids, d = g.search(np.ones((1, 3)), np.array([0]), 10, 160)[0]
    assert len(ids) == 10 and set(d) == {0.0} and 0 not in ids


def test_nearest_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).round(1).tolist()) for i in range(300)]
    rows += [(None, [1.0] * 4), (300, None), (400, []), (500, [1.0, None, 0.0, 0.0]), (600, [1.0, 2.0]), (601, [1.5, 2.0]), (100, rows[100][1]), (200, [9.0] * 4), (5, rows[6][1])]
    df = spark.createDataFrame([(i, v, -1.0, 7) for i, v in rows], "vec_id long, embedding array<float>, score double, shard int")
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and None not in v and any(v)]
    want = Counter()
    for at, (q, a) in enumerate(good):
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), i) for j, (i, b) in enumerate(good) if j != at and len(b) == len(a))[:10]
            want.update((q, k + 1, i) for k, (_, i) in enumerate(d))
    got = Counter((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, k=10, every=100).collect())
    assert got == want
    assert nearest(df.where("vec_id > 9000")).count() == 0 and nearest(df.where("vec_id = 600")).count() == 0
