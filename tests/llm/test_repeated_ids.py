"""Rows that share a doc_id: texts of their own, none of which is lost."""

import random

from foliant.llm import substring


def test_rows_of_one_id_are_documents_of_their_own(spark):
    random.seed(3)
    words = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    a, b = words(120), words(200)
    rows = [(1, a), (2, f"{words(5)} {a} {words(5)}"), (2, b), (3, b), (None, a), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passages = substring.find_passages(docs)
    assert {(p.doc_id, p.source_id) for p in passages.collect()} == {(2, 1), (3, 2)}
    left = [(r.doc_id, r.text) for r in substring.remove_passages(docs, passages).collect()]
    assert (2, b) in left and (1, a) in left and (None, a) in left and (4, None) in left
    assert sorted(len(t.split()) for i, t in left if i == 2) == [10, 200] and [t for i, t in left if i == 3] == [""]


def test_rows_that_are_the_same_count_as_one(spark):
    random.seed(4)
    text = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text + " more")], "doc_id long, text string")
    left = sorted((r.doc_id, len(r.text.split())) for r in substring.remove_passages(docs, substring.find_passages(docs)).collect())
    assert left[:2] == [(1, 80), (1, 80)] and [n for i, n in left if i == 2][0] == 0
