"""Every stage of the pipeline on its own input, against what its operator says."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import queries, simhash
from foliant.llm.common import table, write_table
from foliant.llm.tokens import ids_of, tokenizer_path

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, write_table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
        if name == "toxicity":
            score = queries.op10_toxicity(spark, SF).where("score < 0.7")
            assert set(kept[-1]) == {r.doc_id for r in score.collect()}
        elif name == "simhash":
            want = {r.doc_id for r in simhash.near_duplicates(before).where("doc_id = component_id").collect()}
            assert set(kept[-1]) == want
        elif name == "mixing":
            assert set(kept[-1]) == {r.doc_id for r in queries.mixed(before).where("kept").collect()}
    clean, first, cut, mixed = kept
    assert set(clean) >= set(first) == set(cut) >= set(mixed)
    assert any(len(cut[i] or "") < len(first[i] or "") for i in cut)
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    all_ids = {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert sum(labels.get(i) == 1 for i in all_ids - set(clean)) >= 0.5 * sum(labels.get(i) == 1 for i in all_ids)
    assert sum(labels.get(i) == 0 for i in all_ids - set(clean)) <= 0.02 * len(all_ids)
    encode = ids_of(tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(np.frombuffer(encode(t), "<u4")) + 1 for i, t in mixed.items()}
