"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator has a result."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import embed_graph, media, mixing, packing, quality, queries, sharding, simhash, substring, token_store, toxicity
from foliant.llm.learning import fold
from foliant.llm.tokens import tokenizer_path

from .conftest import ODD

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s, [(4, None, 1), (None, 1, None)]), fold(F.col("doc_id"), 4) != 2)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s, [(4, 1, None), (None, 1, 1)]), fold(F.col("doc_id"), 3) != 1)),
    "token_store": lambda s, d: token_store.round_trip(d, WORDS),
    "media": lambda s, d: media.digests(media.media_features(media.store_media(d))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "mixing": lambda s, d: queries.mixed(d),
    "sharding": lambda s, d: sharding.shard_by_bytes(d, 3),
    "substring": lambda s, d: substring.remove_passages(d, substring.find_passages(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, docs, name):
    got = OPERATORS[name](spark, docs(ODD)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    if name in ("quality", "toxicity"):
        assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs([])).count() == 0


CLASHES = ["score", "tokens", "probability", "draw", "kept", "topic", "_doc", "_spans", "_salt", "row", "cut", "spans", "label"]


def test_columns_of_any_name_stay(spark):
    """The stages' own names as columns of the documents: all come through as they were."""
    import corpus_pipeline

    rows = [(i, f"some text {i} " * (i % 5 + 1), "en", "src1", 9, *[f"{c}{i}" for c in CLASHES]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    want = {r.doc_id: r for r in docs.collect()}
    for got in (corpus_pipeline.mix_sources(spark, docs, ""), substring.remove_passages(docs, substring.find_passages(docs)), simhash.keep_first(docs)):
        assert got.columns == docs.columns and all(all(r[c] == want[r.doc_id][c] for c in CLASHES) for r in got.collect())
    got = quality.score(docs, quality.train(docs, labels(spark, []), F.lit(True)), name="other")
    assert all(r["score"] == want[r.doc_id]["score"] and r["other"] == 1.0 for r in got.collect())


def test_packing_of_odd_rows_is_whole(spark, docs):
    got = packing.pack(docs(ODD), BYTES).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {}
    for i, t in ODD:
        want[i] = want.get(i, 0) + len(queries.packing.ids_of(BYTES)(t)) // 4 + 1
    assert {r.doc_id: r.n for r in got} == want
    assert packing.pack(docs([]), BYTES).count() == 0


def test_embeddings_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (7, [], 1), (8, [1.0, 0.0], 1), (9, [1.0, -0.0], 1), (9, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    got = embed_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x"))).collect()
    assert len(got) == len(rows)
    linked = {r.vec_id for r in got if r.n_links}
    assert linked == {8, 9}
    assert {r.vec_id: r.component_id for r in got}[9] == 8
    assert embed_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_margins_are_values(spark):
    d = spark.createDataFrame([(i, "a b c", None if i % 2 else "s", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    got = mixing.mix(d, {"source": {"s": 0.5}}, F.lit(3).cast("long"))
    assert got.count() == 40 and {round(r[0], 6) for r in got.select("probability").distinct().collect()} == {1.0}


def test_nulls_and_unlisted_values_under_the_production_targets(spark):
    sources, langs = ["src0", "src1", None, "elsewhere"], ["en", "fr", None, "pt"]
    rows = [(i, "a b c", sources[i % 4], langs[i // 4 % 4]) for i in range(160)]
    got = queries.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert len(got) == 160 and all(0 < r.probability <= 1 for r in got)
    weight = lambda column, value: sum(r.probability for r in got if r[column] == value) / sum(r.probability for r in got)
    assert all(abs(weight("source", s) - 0.25) < 1e-6 for s in sources)
    # Languages without a target keep their half; the named ones share the other by their targets.
    assert all(abs(weight("lang", v) - w) < 1e-6 for v, w in [("en", 0.55 / 0.7 / 2), ("fr", 0.15 / 0.7 / 2), (None, 0.25), ("pt", 0.25)])
