"""Training by hand, beginnings of frequent neutral words, and the laws of segments."""

import math
import random
import re
from collections import Counter

import pytest

from chronoloom.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """1,000 documents, 200 of them toxic, that share 40 neutral words; toxic ones have three of six toxic words besides."""
    r = random.Random(5)
    letters = "bcdfghjklmnpqrstvwxz"
    neutral = [a + b + "omenal" for a, b in zip(letters * 2, "aeiou" * 8)]
    toxic = [a + "uzzgrim" for a in "bdfgkp"]
    docs = [(i, r.choices(neutral, k=30) + (r.choices(toxic, k=3) if i % 5 == 0 else []), int(i % 5 == 0)) for i in range(1000)]
    for _, words, _ in docs:
        r.shuffle(words)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w, _ in docs], "doc_id long, text string")
    return d, spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, toxic int"), neutral, toxic


def test_neutral_words_do_not_sink(labelled):
    docs, labels, neutral, toxic = labelled
    model = toxicity.train(docs, labels)
    assert not [u for u, s in model.units.items() if u.endswith("*") and s < 0]
    assert min(model.word(w) for w in neutral) > -1
    assert all(model.word(w) > 1 for w in toxic)


def by_hand(rows, labels):
    """The model by its definitions, in plain loops: units, documents' share, and the laws of clean and toxic texts."""
    toxic_of = {}
    for i, t in labels:
        if i is not None and t is not None:
            toxic_of[i] = max(t, toxic_of.get(i, 0))
    texts = {}
    for i, t in rows:
        if i in toxic_of:
            texts[t or ""] = max(toxic_of[i], texts.get(t or "", 0))
    words = {}
    for text, toxic in texts.items():
        found = re.findall(r"[^\W\d_]+", text.lower())
        for w in set(found):
            i = found.index(w)
            c = words.setdefault(w, [0, 0, set()])
            c[toxic] += 1
            if toxic:
                c[2].add((found[max(0, i - 1)], found[i + 1] if i + 1 < len(found) else ""))
    counts = {w: [c, t, len(near)] for w, (c, t, near) in words.items()}
    whole = dict(counts)
    for w, (c, t, near) in whole.items():
        damp = math.log2(1 + c + t) / (c + t)
        for k in range(3, 9):
            if k < len(w):
                s = counts.setdefault(w[:k] + "*", [0.0, 0.0, 0.0])
                for j, x in enumerate((c, t, near)):
                    s[j] += round(x * damp, 6)
    clean, bad = (sum(whole[w][j] for w in whole) for j in (0, 1))
    base = bad / (clean + bad)
    prior = math.log(base / (1 - base))
    units = {}
    for u, (c, t, near) in counts.items():
        nt, nc = min(t, near) + base, c + 1 - base
        odds, sd = math.log(nt / nc) - prior, math.sqrt(1 / nt + 1 / nc)
        s = min(12, odds - 2 * sd) if odds > 0 else odds + 2 * sd
        if abs(odds) / sd >= 3.3 and c + t >= 4 and (s > 1 or s < -0.25):
            units[u] = s
    longest = lambda w: next((units[w[:k] + "*"] for k in range(8, 2, -1) if k < len(w) and w[:k] + "*" in units), -0.25)
    settled = {}
    for w, (c, t, near) in whole.items():
        if w not in units and longest(w) > 0:
            p = 1 / (1 + math.exp(-longest(w) - prior))
            nt, nc = min(t, near) + 4 * p, c + 4 * (1 - p)
            s = math.log(nt / nc) - prior - 2 * math.sqrt(1 / nt + 1 / nc)
            settled[w] = s if s > 1 else -0.25
    return units | settled, sum(texts.values()) / len(texts)


def test_training_by_hand(labelled):
    docs, labels, _, toxic = labelled
    more = [(i, " ".join([f"plainest quietest softest {w}" for w in toxic[:3] * (i < 1020)] or ["plainest quietest softest"]) + " " + chr(97 + i % 26) * (i % 89)) for i in range(1000, 3000)]
    more += [(3000, None), (None, "buzzgrim"), (1, more[5][1]), (3001, "buzzgrimly fuzzgrimmer Zzz"), (3002, "guzzgrimmest"), (3003, "duzzgrimling plainest")]
    rows = [tuple(r) for r in docs.collect()] + more
    tags = [tuple(r) for r in labels.collect()] + [(i, int(i is not None and i < 1020)) for i, _ in more] + [(None, 1), (7, None), (3001, 0), (3002, 1)]
    spark = docs.sparkSession
    model = toxicity.train(spark.createDataFrame(rows, docs.schema).repartition(5), spark.createDataFrame(tags, "doc_id long, toxic int"))
    units, share = by_hand(rows, tags)
    assert set(model.units) == set(units) and len([s for s in units.values() if s < 0]) > 3
    assert all(abs(model.units[u] - s) < 1e-6 for u, s in units.items())
    assert abs(model.base - share) < 1e-9


def test_law_of_random_text():
    """The fitted law tells how often random clean texts reach a score."""
    r = random.Random(11)
    scores, p = (-0.25, -0.6, 1.5, 2.0), (0.6, 0.37, 0.02, 0.01)
    draw = lambda n: [r.choices(scores, p)[0] for _ in range(n)]
    best = lambda s: max((z for *_, z in toxicity.segments(s)), default=0.0)
    texts = [draw(r.choice((50, 200, 400))) for _ in range(3000)]
    hits = Counter(x for t in texts for x in t)
    decay, factor = toxicity.extreme_value_law(hits, [(len(t), best(t)) for t in texts])
    model = toxicity.Model({}, 0.1, decay, factor)
    fresh = [model.surprise(best(draw(300)), 300) for _ in range(4000)]
    for level in (1.0, 2.0, 3.0):
        expected = 1 - math.exp(-math.exp(-level))
        assert 0.4 * expected < sum(x >= level for x in fresh) / len(fresh) < 2.0 * expected


def test_segment_ends_are_characters():
    model = toxicity.Model({"bad": 5.0, "worse": 5.0}, 0.1, 1.0, 0.01)
    for text in ("\u0130x yy bad", "plain bad worse here", "\u0130\u0130 bad. Worse"):
        _, found = model.judge(text)
        assert found and text[found[0][0] : found[0][1]].lower() in ("bad", "bad worse", "bad. worse")


def test_several_segments_together():
    model = toxicity.Model({}, 0.1, 1.0, 1.0)
    assert model.together([3.0]) == 3.0 and model.together([-1.0, -2.0]) == -1.0
    # Two segments surprise more than one of them, but less than their sum.
    assert 6.0 < model.together([6.0, 6.0]) < 12.0
    assert model.together([9.0, 0.1]) >= 9.0
