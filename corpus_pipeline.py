"""A corpus pipeline of five of the operators: toxicity, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and gives it, read again, to the
next. All stages but the last return the columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import packing, queries, simhash, substring, toxicity
from foliant.llm.common import table, write_table
from foliant.llm.learning import fold
from foliant.llm.tokens import tokenizer_path


def whole_rows(docs: DataFrame, *names: str) -> DataFrame:
    """The rows as one column, and those that an operator needs beside it: what the operator adds clashes with nothing."""
    return docs.select(F.struct("*").alias("_row"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more go; the model learns from labelled rows outside the held-out third."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(whole_rows(docs, "text"), model).where("score < 0.7").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; all documents stay."""
    return substring.remove_passages(docs, write_table(substring.find_passages(docs), "passages"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents with the target shares of sources, languages and topics."""
    return queries.mixed(whole_rows(docs, "doc_id", "text", "source", "lang")).where("kept").select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with a digest of their ids."""
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", cut_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The classifier, the fuzzy passages and the tokenizer can't be put in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
