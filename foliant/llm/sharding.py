"""Shards of nearly equal bytes: a minimax contiguous partition of groups of equal texts.

Groups are atomic and ordered by their least doc_id. The smallest capacity for which greedy cutting needs no more than the
wanted shards is found by searching: each round tries many capacities at once, and a cut of all of them is one aggregate
over the groups' running sums. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_of_equal, running_totals, write_table

#: Capacities tried in a round.
PROBES = 31


def smallest_capacity(sums: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """The least capacity, and the running sums at which its greedy shards end. `sums` (size, upto): a row for each group."""

    def cuts(capacities: list[int]) -> list[list[int]]:
        at, out = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(shards):
            ends = sums.where((F.col("upto") > min(at)) & (F.col("upto") <= max(a + c for a, c in zip(at, capacities)))).agg(
                *[F.max(F.when(F.col("upto") <= a + c, F.col("upto"))).alias(f"e{i}") for i, (a, c) in enumerate(zip(at, capacities))]).first()
            at = [max(a, e) if e is not None else a for a, e in zip(at, ends)]
            for o, a in zip(out, at):
                o.append(a)
            if min(at) >= total:
                break
        return out

    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the upper one always does
    best = None
    while low < high or best is None:
        tried = sorted({low + (high - low) * i // (PROBES + 1) for i in range(PROBES + 1)} | {high})
        done = cuts(tried)
        first = next(i for i, ends in enumerate(done) if ends[-1] >= total)
        best, high, low = done[first], tried[first], tried[first - 1] + 1 if first else tried[first]
    return high, best


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, group_id, shard, slot) of all rows of `docs` (doc_id unique, text; others are left alone).

    size: UTF-8 bytes and 1. A null text is an empty one, and all equal texts are in one shard; group_id is the least
    doc_id of a text (null, which comes first, if no row of the text has an id). slot counts a shard's rows from 0 by (group_id, doc_id). No rows: no rows. A group larger than an
    even share makes its shard that large and no larger.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))
    rows = write_table(group_of_equal(rows, "text_md5", "doc_id", "group_id").drop("text_md5"), "grouped")
    groups = rows.groupBy("group_id").agg(F.sum("size").alias("bytes"))
    sums = running_totals(groups, ["group_id"], {"before": F.col("bytes")}).select("group_id", F.col("bytes").alias("size"), (F.col("before") + F.col("bytes")).alias("upto"))
    sums = write_table(sums, "sums")
    total, largest = sums.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ends = smallest_capacity(sums, shards, total, largest)[1] if total else []
    inner = sorted({e for e in ends if e < total})
    lasts = [r.group_id for r in sums.where(F.col("upto").isin(inner)).select("group_id").orderBy("group_id").collect()] if inner else []
    shard = F.lit(0)
    for last in lasts:  # as many as there are shards, less one
        shard += F.coalesce(F.col("group_id") > last, F.lit(False)).cast("int") if last is not None else F.col("group_id").isNotNull().cast("int")
    placed = rows.withColumn("shard", shard)
    numbered = running_totals(placed, ["group_id", "doc_id"], {"place": F.lit(1)})
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    first = F.lit(0)
    for s in range(1, shards):
        first = F.when(F.col("shard") == s, F.lit(sum(counts.get(i, 0) for i in range(s)))).otherwise(first)
    return numbered.select("doc_id", "size", "text_crc32", "group_id", "shard", (F.col("place") - first).cast("long").alias("slot"))
