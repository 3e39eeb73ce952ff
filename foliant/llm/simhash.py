"""SimHash near-duplicates by a generalised pigeonhole.

Two fingerprints that differ in at most R bits differ, in some partition i of the bits, in at most t[i] bits, if the t sum
to R - m + 1 over the m partitions (-1: the partition need not be looked at). Correlated bits share a partition, and the
thresholds are those of the least estimated cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, write_table

BITS, RADIUS, SEED = 64, 3, 42
#: Partitions, and what a row that is shuffled costs against one that is compared.
PARTS, ROW_COST = 4, 50.0


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of its shingles' hashes. No words: 0."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: folds A-Z and cuts at ASCII white space alone
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - words_each + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    digest = xxhash.xxh64_intdigest
    last = ends[-n:] - 1
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) of whole texts; null texts count as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fingerprint"))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many of them each two bits are set: 64 x 64 counts from each task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(own, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"i": np.append(np.arange(BITS * BITS), -1), "n": np.append(both.ravel(), n).astype(np.int64)})

    rows = prints.select("fingerprint").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    got = np.zeros(BITS * BITS + 1)
    for r in rows:
        got[r.i] = r.n
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Equal parts; each grows from the freest bit by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = list(range(BITS)), []
    for k in range(parts):
        first = min(free, key=lambda b: (-corr[b, free].sum(), b))
        part = [first]
        free.remove(first)
        while len(part) < BITS // parts + (k < BITS % parts):
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def costs(n: int, both: np.ndarray, parts: list[list[int]], radius: int, equal: list[float]) -> list[list[float]]:
    """cost[i][t + 1] of threshold t in partition i: rows to shuffle and pairs to compare.

    equal[i]: ordered pairs of rows that agree in partition i, as counted. For t > 0 they are scaled by how much likelier
    a distance of t or less is than 0, if bits were independent.
    """
    p = np.diag(both) / max(n, 1)
    out = []
    for part, same in zip(parts, equal):
        dist = np.array([1.0])
        for b in part:
            differ = 2 * p[b] * (1 - p[b])
            dist = np.convolve(dist, [1 - differ, differ])
        within = np.cumsum(dist)
        row = [0.0]
        for t in range(radius + 1):
            probes = sum(comb(len(part), d) for d in range(min(t, len(part)) + 1))
            row.append(ROW_COST * n * (1 + probes) + same * float(within[min(t, len(part))] / max(dist[0], 1e-300)))
        out.append(row)
    return out


def allocate(cost: list[list[float]], radius: int) -> list[int]:
    """Thresholds of the least total cost that sum to radius - m + 1, by dynamic programming over the partitions."""
    m, need = len(cost), radius + 1  # of thresholds + 1, each at least 0
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for row in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best[-1].items():
            for extra in range(min(len(row) - 1, need - used) + 1):
                value = (total + row[extra], [*chosen, extra - 1])
                if used + extra not in now or value < now[used + extra]:
                    now[used + extra] = value
        best.append(now)
    assert sum(best[-1][need][1]) == radius - m + 1
    return best[-1][need][1]


def _key(part: list[int]):
    """The partition's bits of the fingerprint, in place."""
    mask = sum(1 << b for b in part)
    return F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(part: list[int], t: int) -> list[int]:
    masks = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(part, d)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(rep, component): for each distinct fingerprint of `prints` (fingerprint, rep) the least rep within reach.

    Exact: every pair within the radius is met in some partition. First each bucket's members are tied to its least one
    where that is near; groups of many near copies fall together that way, and only pairs of different groups are then
    looked for, so what comes out of the join doesn't grow with the square of a group.
    """
    n, both = bit_statistics(prints)
    parts = partition_bits(n, both)
    keyed = prints.select("fingerprint", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(p).alias("key")) for i, p in enumerate(parts)])).alias("k")).select("fingerprint", "rep", "k.*")
    keyed = write_table(keyed, "keyed")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("c"), F.min("rep").alias("least"))
    equal = {r.part: float(r.s) for r in sizes.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()}
    thresholds = allocate(costs(n, both, parts, radius, [equal.get(i, 0.0) for i in range(len(parts))]), radius)

    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    heads = keyed.alias("k").join(sizes.where("c > 1").select("part", "key", "least").alias("s"), ["part", "key"]).where("rep = least").select("part", "key", F.col("fingerprint").alias("head_print"), F.col("rep").alias("head"))
    stars = keyed.join(heads, ["part", "key"]).where((F.col("rep") != F.col("head")) & near("fingerprint", "head_print")).select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    labels = components(stars)
    labelled = write_table(prints.join(labels, prints.rep == labels.node, "left").select("fingerprint", "rep", F.coalesce("component", "rep").alias("label")), "labelled")

    side = lambda i: labelled.select("fingerprint", "label", F.lit(i).alias("part"), _key(parts[i]).alias("key"))
    used = [i for i, t in enumerate(thresholds) if t >= 0]
    index, probes = None, None
    for i in used:
        flips = F.array(*[F.lit(f) for f in _flips(parts[i], thresholds[i])])
        probe = side(i).withColumn("key", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f)))) if thresholds[i] else side(i)
        index, probes = (side(i), probe) if index is None else (index.union(side(i)), probes.union(probe))
    a, b = probes.alias("a"), index.alias("b")
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label")) & near("a.fingerprint", "b.fingerprint"))
    links = components(met.select(F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct())
    return labelled.join(links, labelled.label == links.node, "left").select("fingerprint", "rep", F.coalesce("component", "label").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text; other columns are left alone).

    component_id is the least doc_id that links of at most `radius` differing bits reach. Null and empty texts have
    fingerprint 0 and are linked like any other; equal fingerprints are one node; no rows give no rows.
    """
    prints = write_table(fingerprints(docs), "fingerprints")
    reps = write_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "reps")
    groups = link_groups(reps, radius)
    return prints.join(groups.select("fingerprint", F.col("component").alias("component_id")), "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`docs` without those that have a smaller doc_id in their group; rows that repeat the least doc_id stay."""
    gone = near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
