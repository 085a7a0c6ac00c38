"""Rows that share an id but not their text."""

from chronoloom.llm import jaccard


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    # 1 twice with unlinked texts; 2 is a near copy of one of them; 3 is there twice, once as a near copy of 2.
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, b + " other"), (3, c), (4, ""), (4, c + " more"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.first_of_each_component(docs).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, c), (4, ""), (5, None)], key=repr)
