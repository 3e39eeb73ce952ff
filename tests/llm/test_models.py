"""Held-out accuracy of the two classifiers, and the mixing targets."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


# With 33 toxic rows to learn from, dictionaries trained on whole texts tell less than a list of words would: 0.89.
@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_rows_are_told_apart(spark, name, label, least):
    scored = queries.QUERIES[name](spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(F.col(label).isNotNull()).select("score", label).collect()
    assert auc([tuple(r) for r in rows]) > least


def test_compression_distance_against_plain_calls():
    """The bytes that the toxic dictionary saves on a window, by the library called afresh; and dictionaries that hold no hand-picked word."""
    import zstandard

    toxic = [f"text {i} zorgon blatt and more words {i % 7}" for i in range(40)]
    plain = [f"text {i} harmless thing and more words {i % 7}" for i in range(80)]
    model = toxicity.Model([(t, 1) for t in toxic] + [(t, 0) for t in plain])
    saved = toxicity._Saved(model.toxic, model.ordinary)
    for window in (b"zorgon", b"harmless", b"more", b"x" * 32):
        sizes = []
        for content in (model.ordinary, model.toxic):
            held = zstandard.ZstdCompressionDict(content + toxicity.TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False).compress(b" " + window + b" " + toxicity.TRAILER)))
        assert abs(saved[window] - (sizes[0] - sizes[1])) <= 1
    scores = model.scores(["a zorgon blatt", "a harmless thing", "", None])
    assert scores[0] > 0.7 > scores[1] and ((scores >= 0) & (scores <= 1)).all() and scores[2] == scores[3]
    assert b"".join(toxicity.windows("A b-1 \t ü" + "x" * 40)).replace(b"x", b"") == "ab-1ü".encode()


def test_regressions_go_with_their_dictionaries(monkeypatch):
    """Texts are scored by the dictionaries that the regressions were fitted with, and no regression saw texts of its dictionaries."""
    made, fitted = [], []
    plain, regression = toxicity.dictionaries, toxicity.Logistic
    monkeypatch.setattr(toxicity, "dictionaries", lambda toxic, ordinary: made.append((toxic + ordinary, plain(toxic, ordinary))) or made[-1][1])
    monkeypatch.setattr(toxicity, "Logistic", lambda x, y, **more: fitted.append((x, y)) or regression(x, y, **more))
    sample = [(f"text {i} zorgon blatt and more words {i % 7}", 1) for i in range(40)] + [(f"text {i} harmless thing and more words {i % 7}", 0) for i in range(80)]
    model = toxicity.Model(sample)
    used = []
    monkeypatch.setattr(toxicity, "_saved", lambda *held: used.append(held) or toxicity._Saved(*held))
    model.scores(["a zorgon blatt"])
    assert used == [held for _, held in made] and len(fitted) == len(used) == 2
    for (texts, held), (x, _) in zip(made, fitted):
        saved, known = toxicity._Saved(*held), {toxicity.family(w) for w in texts}
        others = [toxicity.features(w, saved) for t, _ in sample if toxicity.family(w := toxicity.windows(t)) not in known]
        assert len(x) == len(others) and (x == others).all()


def test_convolution_against_plain_loops():
    """A text's score by loops over chunks, places and filters."""
    import numpy as np

    net = quality.Network(3)
    text = "Some text, é and more. " * 30
    raw = list(text.encode())
    step, best = quality.CHUNK - quality.OVERLAP, []
    for at in range(0, max(1, len(raw) - quality.OVERLAP), step):
        chunk = (raw[at : at + quality.CHUNK + quality.WIDTH] + [0] * 1000)[: quality.CHUNK + quality.WIDTH]
        values = [sum(net.table[j, chunk[i + j]] for j in range(quality.WIDTH)) for i in range(0, quality.CHUNK, quality.STRIDE)]
        best.append(np.tanh(np.max(values, axis=0) + net.bias))
    v = np.array(best)
    h = np.tanh(np.concatenate((v.mean(0), v.max(0), v.min(0))) @ net.w1 + net.b1)
    assert abs(net.score(text) - 1 / (1 + np.exp(-(h @ net.w2 + net.b2[0])))) < 1e-5


def test_mixing_equals_its_sql_and_hits_its_targets(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute("SELECT doc_id, topic, tokens, probability, kept FROM (" + queries.ORACLE_SQL["op6_mixing"] + ")").fetchall()}
    got = queries.op6_mixing(spark, SF).select("doc_id", "topic", "tokens", "probability", "kept")
    assert {tuple(r) for r in got.collect()} == want
    weight = queries.op6_mixing(spark, SF).groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    total = sum(r.w for r in weight)
    assert {r.lang: round(r.w / total, 2) for r in weight} == queries.LANGUAGES
