import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with a column that clashes with names inside the operators."""

    def make(rows, clash="x"):
        full = [(i, t, "en", "src1", None if t is None else len(t), clash) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", shard string")

    return make


#: Nulls, empty and long texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, "   "), (4, "word"), (5, "word"), (5, "word"), (None, "no id here"), (None, None), (6, "Ünïcode ✓ \n\t text " * 900), (7, "a" * 60_000)]
