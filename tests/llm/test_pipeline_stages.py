"""Every stage of the pipeline on odd rows: null ids and texts, repeats, very long texts, clashing columns, no rows."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, `row` string, size string, target int, score string, fp string, words int, piece string, sequence_id string, kind int, `a b` int"


def rows():
    plain = "the quiet harbour town kept its lamps lit through the long winter storm"
    out = [(None, plain + " one two three", None, None), (None, None, "en", "x"), (1, None, None, None), (2, "", "en", None), (3, " \t\n", "de", "x"), (4, "word", "en", "x"), (5, "word", "en", "y")]
    out += [(6, plain, "en", "x")] * 3 + [(7, plain, "en", "y"), (7, "another text of the same id " * 3, "en", "y"), (8, "long " * 60_000 + "end", "en", "x")]
    out += [(9 + i, f"document number {i} speaks of {i * 7} things and of nothing else at all today", "fr", ["x", "y", None][i % 3]) for i in range(20)]
    return [(i, t, lang, s, None if t is None else len(t), 1, "r", "s", 2, "c", "f", 3, "p", "q", 4, 5) for i, t, lang, s in out]


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = STAGES[name](spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert sum(r["length"] for r in got) >= len(rows()) and {r["doc_id"] for r in got} == {r[0] for r in rows()}
        assert max(Counter(r["sequence_id"] for r in got).values()) >= 1
        return
    assert out.columns == docs.columns
    before, after = Counter(map(repr, rows())), Counter(repr(tuple(r)) for r in got)
    if name == "toxicity":
        assert after == before  # nothing here is toxic
    elif name == "near copies":
        assert set(after) <= set(before)
        texts = Counter(r["text"] for r in got if r["doc_id"] is not None)
        assert all(texts[t] <= 1 for t in texts if t and len(t.split()) > 4)
        assert sum(r["doc_id"] is None for r in got) == 2  # rows without id stay
        assert {r["doc_id"] for r in got if r["doc_id"] is not None} == {r[0] for r in rows() if r[0] is not None} - {5, 7} | {7}
    else:
        assert set(after) <= set(before)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_without_rows(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    out = STAGES[name](spark, docs, SF)
    assert out.collect() == []
    assert name == "packing" or out.columns == docs.columns
