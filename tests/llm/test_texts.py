"""Jaccard join, toxicity and language model against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import gru, jaccard, toxicity
from chronoloom.llm._text import shingle_hashes, string_buffers, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, n int, label int"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3) for i, t in rows], DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least[root(k)] if i is not None else None) for k, (i, s) in enumerate(sets))


def near_copies(seed, groups=12, size=9):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 20, 40, 90)))] + (passage if g % 3 == 0 else [])
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                k = r.randrange(len(w))
                r.choice((lambda: w.__setitem__(k, r.choice(vocabulary)), lambda: w.insert(k, r.choice(vocabulary)), lambda: w.pop(k)))()
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = near_copies(seed)
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, "Éa éa x y z"), (907, "éa éa x y z"), (None, rows[0][1]), (None, None), (908, "same words again and again " * 400), (909, "same words again and again " * 300), (910, "a\xa0b c d e f")]
    rows += [rows[3], (911, rows[3][1])]
    got = jaccard.jaccard_components(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def labelled_rows(spark, rows, **options):
    own, labels = jaccard._labelled(frame(spark, rows).select("doc_id", "text").coalesce(1), 5, (75, 100), **options)
    d = own.join(labels, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return Counter(map(tuple, d.select("doc_id", "n_shingles", component.alias("component_id")).collect()))


@pytest.mark.parametrize("bits", [0, 4])
def test_sets_that_share_a_name_stay_apart(spark, bits):
    rows = near_copies(6, groups=5, size=5) + [(800, None), (801, "a b"), (802, "a b"), (None, "x y z")]
    assert labelled_rows(spark, rows, bits=bits) == brute_components(rows)


def test_hot_windows(spark, monkeypatch):
    """A passage that many sets share, and windows that most sets hold, change no link."""
    monkeypatch.setattr(jaccard, "LEAST_HOT", 8)
    line = " ".join(f"line{k}" for k in range(14))
    rows = [(i, f"{t} {line}" if i % 2 else t) for i, t in near_copies(8, groups=14, size=6)] + [(900 + k, line + " end" * (k % 3)) for k in range(12)]
    _, _, hot, n = jaccard._named(frame(spark, rows).select("doc_id", "text").coalesce(1), 5, 64)
    assert len(hot) >= 10 and n.min() >= 8
    assert labelled_rows(spark, rows) == brute_components(rows)


def test_components_grow_by_links(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(70)]
    labels, seen = None, []
    for k in range(0, 70, 14):
        part = [p for p in pairs[k : k + 14] if p[0] != p[1]]
        seen += part
        labels = jaccard.joined_components(labels, spark.createDataFrame([(min(p), max(p)) for p in part], "a long, b long"))
        up = {x: x for p in seen for x in p}

        def root(a, up=up):
            while up[a] != a:
                a = up[a]
            return a

        for a, b in seen:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        assert {r["node"]: r["label"] for r in labels.collect()} == {x: root(x) for x in up}
    assert jaccard.joined_components(labels, spark.createDataFrame([], "a long, b long")).count() == len(up)


def test_no_documents(spark):
    empty = frame(spark, [(1, "x")]).where("doc_id > 1")
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.first_of_each_component(empty).count() == 0


def test_one_of_each_component_stays(spark):
    rows = near_copies(3, groups=5)
    want = {c for _, _, c in brute_components(rows)}
    kept = jaccard.first_of_each_component(frame(spark, rows + rows[:4] + [(None, "x"), (None, None)]))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert kept.columns == frame(spark, rows).columns


def test_hashes_match_words():
    texts = ["Ab  cd\x0bAB", "", None, "ab", "x" * 5000 + " y", "Ünï ünÏ", " lead and trail "]
    import pyarrow as pa

    raw, off = string_buffers(pa.array(texts))
    h, rows = word_hashes(raw, off)
    names = [w for t in texts for w in words(t)]
    assert len(h) == len(names) and rows.tolist() == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()
    assert len(set(h.tolist())) == len(set(names))
    assert [len(s) for s in shingle_hashes(h, rows)] == [len(shingles(t)) for t in texts]


def test_expanded_members_link(spark):
    """Members of two groups link although the groups' heads don't: the chain must not be lost."""
    base = [f"b{k}" for k in range(100)]
    a = base[:96] + [f"x{k}" for k in range(4)]
    chain = [a] + [a[:k] + [f"y{k}"] * (k > 0) + a[k + 1 :] for k in (10, 30, 50, 70)]
    for k in range(1, 6):
        chain.append(base[10 * k :] + [f"z{j}" for j in range(10 * k)])
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect())) == brute_components(rows)


def brute_segments(s):
    """All maximal scoring segments by their definition: recursively, the best segment, then what is left of it and right of it."""
    best = None
    for a in range(len(s)):
        for z in range(a + 1, len(s) + 1):
            t = sum(s[a:z])
            if t > 0 and (best is None or t > best[2] or t == best[2] and z - a < best[1] - best[0]):
                best = (a, z, t)
    if best is None:
        return set()
    a, z, t = best
    return {best} | brute_segments(s[:a]) | {(z + x, z + y, v) for x, y, v in brute_segments(s[z:])}


def test_segments():
    r = random.Random(5)
    for _ in range(200):
        s = [r.choice((-3, -2, -1, 1, 2, 5)) + r.random() / 1000 for _ in range(r.randrange(0, 14))]
        got = {(a, z) for a, z, _ in toxicity.segments(s)}
        assert got == {(a, z) for a, z, _ in brute_segments(s)}


def test_toxicity(spark):
    r = random.Random(7)
    clean, bad = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["nasty", "vile", "zorkal", "zorkum", "zorkix", "zorkev"]
    rows, labels = [], []
    for i in range(900):
        t = [r.choice(clean) for _ in range(r.choice((5, 40, 200)))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randrange(1, 5)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "nasty vile nasty"), (1002, "zorkunknown wordaa"), (1003, " ".join(clean * 200)), (1004, "NASTY"), rows[0]]
    labels += [(None, 1), (5, None), (6, 1), (6, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(docs, lab.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    by = {x["doc_id"]: x for x in got}
    wrong = [i for i, t in labels[:900] if (by[i]["score"] >= 0.5) != bool(t)]
    assert len(wrong) <= 4, wrong
    assert by[None]["score"] >= 0.5 and by[1004]["score"] >= 0.5 and by[1002]["score"] >= 0.5
    assert max(by[i]["score"] for i in (1000, 1001, 1003)) < 0.5
    s = by[1004]["segments"][0]
    assert (s["begin"], s["end"]) == (0, 5) and s["surprise"] > 0
    kept = toxicity.clean_rows(docs, model)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in by.items() if x["score"] < 0.5}


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x["score"] < 0.5 for x in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.where("doc_id > 5"), model).count() == 0


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def lm_rows():
    r = random.Random(9)
    one, two = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(i, " ".join(r.choice(one if i % 2 else two) for _ in range(r.choice((3, 30, 120))))) for i in range(500)]
    return rows + [(600, None), (601, ""), (602, "unseen words only"), (603, "rep " * 700), (None, "a1 a2"), (10, rows[10][1]), (700, "\xa0 É é")]


def learn():
    return ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


@pytest.mark.parametrize("known", [1 << 18, 20, 0])
def test_language_model(spark, known):
    """Counts and base scores against plain Python, whether the tasks hold all counts, a few or none."""
    rows = lm_rows()
    got = gru.scored(frame(spark, rows), learn(), known_words=known, rates=(0.01, 0.003)).collect()
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), None])
    N, V = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = [*words(t), None]
        want[(i, len(w), sum(counts[x] > 0 for x in w), N, round(sum(math.log10((counts[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w), 6))] += 1
    assert Counter((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    plain = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 500 and held(x["doc_id"])]
    assert sum(x["score"] for x in plain) > sum(x["base_score"] for x in plain)
    assert all(x["score"] < 0 for x in got)


def test_language_model_does_not_depend_on_partitions(spark):
    rows = lm_rows()
    scores = []
    for n in (1, 5):
        got = gru.scored(frame(spark, rows[:: 1 if n == 1 else -1]).repartition(n), learn(), known_words=30, rates=(0.01,)).collect()
        scores.append(sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["score"]) for x in got))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(*scores))
    empty = frame(spark, rows).where("doc_id > 9000")
    assert gru.scored(empty, learn(), rates=(0.01,)).count() == 0
    alone = gru.scored(frame(spark, rows[:6]), F.lit(False), rates=(0.01,)).collect()
    assert len(alone) == 6 and {x["train_tokens"] for x in alone} == {0} and all(np.isfinite(x["score"]) for x in alone)


def slow_log_probability(w, symbols):
    """One text's natural log probability, a symbol at a time, by the network's definition."""
    h, total, x = np.zeros(gru.STATE), 0.0, gru._END
    sig = lambda v: 1 / (1 + np.exp(-v))
    for y in [*symbols, gru._END]:
        H = gru.STATE
        a, u = w["embed"][x] @ w["gates"] + w["gates0"], h @ w["turn"]
        z, r = sig(a[:H] + u[:H]), sig(a[H : 2 * H] + u[H : 2 * H])
        n = np.tanh(a[2 * H :] + r * u[2 * H :])
        h = n + z * (h - n)
        out = h @ w["out"] + w["out0"]
        c = y // gru.CLASS
        total += out[c] - np.log(np.exp(out).sum())
        if y != gru._END:
            q = h @ w["word"][c] + w["word0"][c]
            total += q[y % gru.CLASS] - np.log(np.exp(q).sum())
        x = y
    return total


def test_network_by_hand():
    """Likelihoods against a loop over symbols, for texts longer than a window and in any company."""
    w = {k: v.astype(np.float64) for k, v in gru.new_weights(5).items()}
    r = np.random.default_rng(6)
    texts = [r.integers(0, gru._END, n).astype(np.uint16) for n in (0, 1, 5, 31, 32, 33, 100, 64)]
    got = gru.likelihoods(gru.Network({k: v.astype(np.float32) for k, v in w.items()}), texts)
    assert np.allclose(got, [slow_log_probability(w, t.tolist()) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    w = {k: v.astype(np.float64) for k, v in gru.new_weights(3).items()}
    total = sum(np.exp(gru.Network(w)._logits(np.ones((1, gru.STATE)), np.array([y]))[0][0]) for y in range(gru._END + 1))
    assert abs(total - 1) < 1e-9


def test_gradients_are_slopes():
    """Backpropagation through a window with a document's start inside it against finite differences."""
    net = gru.Network({k: v.astype(np.float64) for k, v in gru.new_weights(8).items()})
    r = np.random.default_rng(7)
    docs = [np.array([5, 900, 1050, 5, 77], np.uint16), np.array([1087, 3], np.uint16), np.array([], np.uint16)]
    x, y, fresh, owner = next(gru._windows(docs, 2))
    h = r.standard_normal((x.shape[1], gru.STATE)) * 0.3
    live = owner >= 0
    g, *_ = net.gradients(x, y, fresh, live, h)
    for name, v in net.w.items():
        flat, slope = v.reshape(-1), g[name].reshape(-1)
        for k in [*np.argsort(-np.abs(slope))[:6].tolist(), int(r.integers(len(flat)))]:
            was, e = flat[k], 1e-5
            ends = []
            for d in (e, -e):
                flat[k] = was + d
                ends.append(-net.gradients(x, y, fresh, live, h)[2] / live.sum())
            flat[k] = was
            assert abs((ends[0] - ends[1]) / (2 * e) - slope[k]) < 1e-7 + 1e-4 * abs(slope[k]), name


def test_windows_hold_every_symbol_once():
    r = np.random.default_rng(9)
    docs = [r.integers(0, gru._END, n).astype(np.uint16) for n in (0, 1, 31, 32, 33, 500, 7, 63, 64)]
    for width, stretch in ((4, None), (4, 16), (100, 32), (1, 1000)):
        seen = {i: [] for i in range(len(docs))}
        for x, y, fresh, owner in gru._windows(docs, width, stretch):
            for lane in range(x.shape[1]):
                for t in range(len(x)):
                    if owner[t, lane] >= 0:
                        seen[owner[t, lane]].append((x[t, lane], y[t, lane]))
        for i, d in enumerate(docs):
            whole = [gru._END, *d.tolist(), gru._END]
            assert sorted(seen[i]) == sorted(zip(whole, whole[1:]))


def test_training_lowers_the_loss():
    net = gru.Network(gru.new_weights(3))
    docs = [np.array([1, 2, 3] * 30, np.uint16), np.array([5, 1050], np.uint16)] * 20
    before = gru.likelihoods(net, docs).sum()
    for _ in range(15):
        gru.fit(net, docs, 0.02)
    assert gru.likelihoods(net, docs).sum() > before + 100


def test_large_scores_and_lanes_change_nothing():
    r = np.random.default_rng(4)
    # Weights whose scores a float32 exponential can't hold, and biases far from zero.
    w = {k: (v * (40 if k in ("out", "word") else 1) + (300 if k in ("out0", "word0") else 0)).astype(np.float32) for k, v in gru.new_weights(5).items()}
    texts = [r.integers(0, gru._END, n).astype(np.uint16) for n in (0, 3, 40, 70)]
    got = gru.likelihoods(gru.Network(w), texts)
    want = [slow_log_probability({k: v.astype(np.float64) - (300 if k in ("out0", "word0") else 0) for k, v in w.items()}, t.tolist()) for t in texts]
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-3)


def test_windows_of_training_and_scoring():
    """Training sees the lanes it always had; scoring has wider ones."""
    widths = []
    net, windows = gru.Network(gru.new_weights(3)), gru._windows
    docs = [np.arange(k % 5, dtype=np.uint16) for k in range(1500)]
    seen = lambda *a, **k: (widths.append(w[0].shape[1]) or w for w in windows(*a, **k))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(gru, "_windows", seen)
        gru.fit(net, docs, 0.01)
        trained, widths[:] = max(widths), []
        gru.likelihoods(net, docs)
    assert (trained, max(widths)) == (gru.LANES, gru.WIDE) and gru.WIDE > gru.LANES
