"""Phrase mining against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import _spans, phrases as module
from chronoloom.llm.phrases import phrases


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, most, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, most + 1):
                for i in range(len(p) - k + 1):
                    f[lang, tuple(p[i : i + k])] += 1
    cand = {g: a for g, a in f.items() if len(g[1]) >= 2 and a >= least}
    out = []
    for (lang, g), a in cand.items():
        if any(x == lang and b >= a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (x, h), b in cand.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, score, a, " ".join(g), l, r))
    done = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        done += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (_, s, a, p, l, r) in enumerate(best)]
    return sorted(done)


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = ["New", "york", "CITY", "the", "a", "Straße", "señor", "o'clock", "x-y", "of", "and", "\x00", "É"]
    rows = []
    for i in range(300):
        out = []
        for w in rng.choice(vocabulary, 40, p=rng.dirichlet(np.ones(len(vocabulary)))):
            out += [w, rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! ", "\r\n", "\x0b", " "])]
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(out)))
    rows += [("en", None), ("en", ""), (None, " ,. "), ("xx", "!!"), ("en", "New York City " * 50), ("en", "New York City " * 50)]
    return rows


@pytest.mark.parametrize("most,least,top", [(5, 6, 2000), (3, 4, 7), (1, 2, 5), (2, 1, 50)])
def test_against_brute_force(spark, most, least, top):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, n int, a int")
    got = sorted(tuple(r) for r in phrases(docs, most=most, least=least, top=top).collect())
    assert got == brute(rows, most, least, top)


def test_cut_stretches_and_early_sums_change_nothing(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(lang or "und", text) for lang, text in rows], "lang string, text string")
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    whole, cut = module.Reader(5), module.Reader(5)

    def grams(reader):
        out = Counter()
        for raw, words, lang in reader.read(batch):
            for n, at, _ in words.grams(5, []):
                for i in at.tolist():
                    out[reader.langs[lang[i]], b" ".join(raw[words.starts[j] : words.ends[j]].tobytes() for j in range(i, i + n)).lower().decode()] += 1
        return out

    first = grams(whole)
    monkeypatch.setattr(_spans, "CHUNK", 37)
    assert grams(cut) == first
    want = Counter()
    for lang, text in rows:
        for p in pieces(text):
            for k in range(1, 6):
                for i in range(len(p) - k + 1):
                    want[lang or "und", " ".join(p[i : i + k])] += 1
    assert first == want


def test_no_rows(spark):
    assert phrases(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a = 4_000_000_000_000
    one = spark.range(1).select(F.lit(a).alias("a"), F.lit(3 * a).alias("n"), F.lit(a + 7).alias("l"))
    got = one.select(F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(17,0)) * CAST(l AS DECIMAL(17,0)))")).first()[0]
    assert got == 1000 * a * 3 * a // (a + 7) ** 2
