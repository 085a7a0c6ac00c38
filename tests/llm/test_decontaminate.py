"""Suffix arrays and decontamination against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate
from chronoloom.llm.decontaminate import SuffixArray, clean_rows, contamination


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    d, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            for p in range(len(d) - m + 1):
                if d[p : p + m] == w[j : j + m]:
                    hit |= set(range(p, p + m))
                    ids |= {item} - {None}
    return len(d), len(hit), sorted(ids)


ITEMS = [
    (1, "one two three four five six seven"),
    (2, "Zwei, drei! VIER fünf; sechs sieben"),
    (3, "ab"),
    (4, None),
    (5, " ... "),
    (None, "nobody owns these few words at all"),
    (1, "red green blue cyan"),
    (7, "aa aa aa aa aa aa"),
    (8, "one two three four five six seven"),
]
TEXTS = [
    "One two three four five six seven eight", "x one two three four six seven", "three four five", "two three four five six", None, "", "?!",
    "zwei drei vier fünf sechs; sieben acht", "zwei drei vier fünfx sechs sieben", "ab AB c ab", "nobody owns these few words", "red green blue cyan red green blue cyan",
    "aa aa aa aa aa aa aa aa bb aa aa aa aa", "one two three\x00four_five-six", "ONE1 two three four five",
]


@pytest.mark.parametrize("window", [1, 4, 5, 10])
def test_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    texts = TEXTS + [" ".join(rng.choice(["one", "two", "three", "four", "five", "aa", "ab", "red"], 30)) for _ in range(40)]
    docs = spark.createDataFrame([(i % 20, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, contamination int, found int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contamination(docs, items, window=window)
    assert out.columns == [*docs.columns, "contamination_"]
    got = sorted((r[0], r[1] or "", r[1] is None, r[4].n_words, r[4].n_hit, list(r[4]["items"])) for r in out.collect())
    assert got == sorted((i % 20, t or "", t is None, *brute(t, ITEMS, window)) for i, t in enumerate(texts))
    kept = clean_rows(docs, items, window=window)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1] or "") for r in kept.collect()) == sorted((i % 20, t or "") for i, t in enumerate(texts) if not brute(t, ITEMS, window)[1])


def test_matches_are_the_longest(spark):
    docs = spark.createDataFrame([(0, "x one two three four five six y"), (1, "two three four five six seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "zero one two three four five six seven")], "item_id long, text string")
    got = {r["doc_id"]: r["contamination"] for r in contamination(docs, items, window=4).collect()}
    assert [tuple(m) for m in got[0].matches] == [(9, 1, 1, 6)] and got[0].longest == 6
    assert [tuple(m) for m in got[1].matches] == [(9, 2, 0, 6)] and got[1].n_hit == 6


def test_blocks_of_items_and_cut_items_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("abcdef")
    docs = spark.createDataFrame([(i, " ".join(rng.choice(letters, 80))) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rng.choice(letters, 60))) for i in range(12)] + [(None, "a b c d e f")], "item_id long, text string")
    view = lambda df: sorted((r[0], r[2].n_words, r[2].n_hit, list(r[2]["items"])) for r in df.collect())
    whole = view(contamination(docs, items, window=4))
    assert any(r[2] for r in whole)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 150)
    monkeypatch.setattr(decontaminate, "STRETCH_WORDS", 7)
    assert view(contamination(docs, items, window=4)) == whole


def test_no_rows_and_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.where("false"), items).count() == 0
    r = contamination(docs, items.where("false")).first()["contamination"]
    assert (r.n_words, r.n_hit, r.longest, list(r["items"])) == (3, 0, 0, [])


def test_long_texts_pass_whole(spark):
    long_text = "w " * 700_000 + "this passage stands at the very end " + "q" * 1_500_000 + " tail end"
    docs = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "passage stands at the very end"), (2, "tail end")], "item_id long, text string")
    r = contamination(docs, items, window=5).first()["contamination"]
    assert (r.n_words, r.n_hit, list(r["items"])) == (700_010, 8, [1, 2])


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(0, 4, 500), np.tile([1, 2, 3], 40)]).astype(np.int32)
    order = SuffixArray(text, 600).order
    key = lambda i: [int(x) for x in text[i:]]
    cut = lambda x: x[: x.index(0) + 1] if 0 in x else x
    mine = [cut(key(i)) for i in order]
    assert len(order) == (text > 0).sum() and all(text[i] for i in order) and mine == sorted(mine)


def test_query_on_the_given_tables(spark):
    from chronoloom.llm.queries import op11_decontaminate

    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_decontaminate(spark, sf).collect()
    assert len(got) == len(texts)
    known = {w for _, t in items for w in words(t)}
    for r in got:
        assert r["n_words"] == len(words(texts[r["doc_id"]]))
        if r["contaminated"] or len([w for w in words(texts[r["doc_id"]]) if w in known]) > 10:
            n, hit, ids = brute(texts[r["doc_id"]], items, 10)
            assert (r["n_hit"], r["n_items"]) == (hit, len(ids))
