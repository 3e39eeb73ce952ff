"""Embedding near-duplicates by a robust-pruned flat graph, built on overlapping shards and searched by expanding range.

Vectors of one label are dealt to cells: the SPREAD nearest of centroids that a bounded sample gives. A cell that is larger
than SHARD vectors is cut into blocks, and every two of its blocks make a shard, so shards stay bounded and each pair of a
cell still meets in one. A shard links each vector to robust-pruned neighbours; a vector's lists from all its shards are
united, parts of a shard's graph are joined; every vector is then searched for in each of its shards, from the medoid and from
its own place, and from where the search ends as far as the range reaches. A pair belongs to the first shard that both are in, so links are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_table, group_of_equal, write_table

THRESHOLD = 0.93
#: Vectors of the sample that the centroids are fitted on; vectors meant for a cell; cells a label has at most; cells a vector is in.
SAMPLE, CELL, MOST_CELLS, SPREAD = 20_000, 512, 1024, 3
#: Vectors of a shard at most; neighbours kept by pruning and its slack; the beam; queries searched at once.
SHARD, DEGREE, ALPHA, BEAM, QUERIES = 2048, 24, 1.2, 24, 256
#: Pairs of vectors whose cosines are in memory at once.
PAIRS = 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a centroid that loses all its vectors stays where it was."""
    r = np.random.default_rng(seed)
    centre = sample[np.sort(r.permutation(len(sample))[:k])].copy()
    for _ in range(rounds):
        near = (sample @ centre.T).argmax(1)
        for c in np.unique(near):
            m = sample[near == c].sum(0)
            size = np.linalg.norm(m)
            if size > 0:
                centre[c] = m / size
    return centre


def prune(v: np.ndarray) -> list[np.ndarray]:
    """Robust pruning of each vector's nearest 4 * DEGREE: a neighbour goes if a nearer kept one is ALPHA times nearer to it."""
    n = len(v)
    m = min(n - 1, 4 * DEGREE)
    out = []
    for at in range(0, n, QUERIES):
        sim = v[at : at + QUERIES] @ v.T
        rows = np.arange(len(sim))
        sim[rows, rows + at] = -2
        near = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(-sim, axis=1, kind="stable")[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        dist = np.maximum(0, 2 - 2 * np.take_along_axis(sim, near, 1))
        alive, kept, count = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(sim), int)
        for j in range(m):
            take = alive[:, j] & (count < DEGREE)
            if not take.any():
                continue
            kept[take, j] = True
            count += take
            t = np.flatnonzero(take)
            between = np.maximum(0, 2 - 2 * np.einsum("qd,qmd->qm", v[near[t, j]], v[near[t, j + 1 :]])) if j + 1 < m else np.zeros((len(t), 0))
            alive[t[:, None], np.arange(j + 1, m)[None]] &= ALPHA * ALPHA * between > dist[t, j + 1 :]
        out += [near[i][kept[i]] for i in range(len(sim))]
    return out


class Edges:
    """Neighbours of each place, one list after the other: a hub costs what it has, and no other place is padded to it."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        """An edge leads both ways."""
        code = np.unique(np.concatenate((a * n + b, b * n + a)))
        self.to = code % n
        self.start = np.searchsorted(code // n, np.arange(n + 1))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into places, neighbour) of all their neighbours."""
        size = self.start[places + 1] - self.start[places]
        row = np.repeat(np.arange(len(places)), size)
        return row, self.to[np.arange(len(row)) + np.repeat(self.start[places] - np.cumsum(size) + size, size)]


def similarities(q: np.ndarray, v: np.ndarray, qi: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi))
    for i in range(0, len(qi), PAIRS):
        out[i : i + PAIRS] = np.einsum("pd,pd->p", q[qi[i : i + PAIRS]], v[at[i : i + PAIRS]])
    return out


def search(v: np.ndarray, edges: Edges, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of what lies within the range of each query (places in v).

    Greedy search with a beam from the medoid and the query's own place; then every place in range passes the search on to its neighbours. A place is
    compared with a query once, and PAIRS of them at a time are in memory.
    """
    n = len(v)
    medoid = int((v @ v.mean(0)).argmax())
    q = v[queries]
    rows = np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    flat, stamp = seen.ravel(), np.empty(seen.size, np.int32)
    beam_at = np.full((len(q), BEAM), medoid)
    beam_sim = np.full((len(q), BEAM), -2.0)
    beam_sim[:, 0] = q @ v[medoid]
    beam_at[:, 1], beam_sim[:, 1] = queries, np.where(queries == medoid, -2.0, 1.0)
    done = np.ones((len(q), BEAM), bool)
    done[:, 0] = False
    done[:, 1] = queries == medoid
    seen[:, medoid] = True
    seen[rows, queries] = True
    in_q, in_at = [], []

    def look(front_q: np.ndarray, front_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the front's neighbours are that weren't seen: query, place, similarity, whether it is in range."""
        row, at = edges.of(front_at)
        code = front_q[row] * n + at
        code = code[~flat[code]]
        stamp[code] = np.arange(len(code))
        code = code[stamp[code] == np.arange(len(code))]  # each once
        flat[code] = True
        qi, at = code // n, code % n
        sim = similarities(q, v, qi, at)
        hit = sim >= threshold
        in_q.append(qi[hit])
        in_at.append(at[hit])
        return qi, at, sim, hit

    near = beam_sim[:, 0] >= threshold
    in_q += [rows[near], np.flatnonzero(queries != medoid)]
    in_at += [np.full(int(near.sum()), medoid), queries[queries != medoid]]
    while True:
        open_sim = np.where(done, -3, beam_sim)
        best = open_sim.argmax(1)
        act = np.flatnonzero(open_sim[rows, best] > -3)
        if not len(act):
            break
        done[act, best[act]] = True
        qi, at, sim, _ = look(act, beam_at[act, best[act]])
        order = np.lexsort((-sim, qi))
        qi, at, sim = qi[order], at[order], sim[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < BEAM
        new_at, new_sim, new_done = np.full((len(q), BEAM), medoid), np.full((len(q), BEAM), -2.0), np.ones((len(q), BEAM), bool)
        new_at[qi[top], rank[top]], new_sim[qi[top], rank[top]], new_done[qi[top], rank[top]] = at[top], sim[top], False
        all_at, all_sim, all_done = np.concatenate((beam_at, new_at), 1), np.concatenate((beam_sim, new_sim), 1), np.concatenate((done, new_done), 1)
        order = np.argpartition(-all_sim, BEAM - 1, axis=1)[:, :BEAM]
        beam_at, beam_sim, done = (np.take_along_axis(x, order, 1) for x in (all_at, all_sim, all_done))
    fronts = [(np.concatenate(in_q), np.concatenate(in_at))]
    while fronts:
        front_q, front_at = fronts.pop()
        if len(front_q) > PAIRS // DEGREE:
            half = len(front_q) // 2
            fronts += [(front_q[:half], front_at[:half]), (front_q[half:], front_at[half:])]
        elif len(front_q):
            qi, at, _, hit = look(front_q, front_at)
            fronts.append((qi[hit], at[hit]))
    return np.concatenate(in_q), np.concatenate(in_at)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b, pair by pair, in place; root is each place's least one and stays so."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root[:] = root[root]


def join_parts(v: np.ndarray, edges: Edges, threshold: float) -> Edges:
    """`edges`, and where they leave the graph in parts, edges between those.

    Each part is linked to the medoid at its nearest place, and each place to the nearest of every other part that is in range.
    """
    n = len(v)
    root, a = np.arange(n), np.repeat(np.arange(n), np.diff(edges.start))
    unite(root, a, edges.to)
    heads = np.unique(root)
    if len(heads) < 2:
        return edges
    medoid = int((v @ v.mean(0)).argmax())
    to_medoid = v @ v[medoid]
    more_a, more_b = [a], [edges.to]
    for h in heads:
        own = np.flatnonzero(root == h)
        more_a.append(own[[to_medoid[own].argmax()]])
        more_b.append(np.array([medoid]))
        others = np.flatnonzero(root != h)
        for at in range(0, len(others), QUERIES):
            sim = v[others[at : at + QUERIES]] @ v[own].T
            near = sim.argmax(1)
            ok = sim[np.arange(len(sim)), near] >= threshold
            more_a.append(others[at : at + QUERIES][ok])
            more_b.append(own[near[ok]])
    a, b = np.concatenate(more_a), np.concatenate(more_b)
    return Edges(n, a[a != b], b[a != b])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """The rows that can link: an id, a label, a vector without nulls or non-finite parts, not all zero."""
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where("vec_id is not null and label is not null and embedding is not null").where((F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def link(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, reps, links) of `rows` (row, vec_id, embedding, label; row is unique).

    classes: (row, rep), equal vectors of a label being one class, named by its least row. reps: (rep, copies, least, n), least being the least vec_id
    of the class and n its links to vectors of other classes. links: (a, b) some links between classes that join whatever links join.
    Vectors that cannot link are in none of them.
    """
    spark = rows.sparkSession
    base = valid_vectors(rows)
    # -0.0 and 0.0 are one value here.
    base = base.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    keyed = base.withColumn("_key", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: x.cast("string")))))
    classes = write_table(group_of_equal(keyed, "_key", "row", "rep").drop("_key"), "classes")
    groups = classes.groupBy("rep").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = write_table(classes.where("row = rep").select("label", "rep", "embedding").join(groups, "rep").select("label", "rep", "copies", "embedding", "least"), "reps")
    sizes = {r.label: r["count"] for r in reps.groupBy("label").count().collect()}  # labels are classes of a task: few
    total = sum(sizes.values())
    rows = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30)) + 1).select("label", "rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(2 * SAMPLE).collect()
    by_label: dict = {}
    for r in rows:
        by_label.setdefault((r.label, len(r.embedding)), []).append(r.embedding)
    centroids = {key: fit_centroids(unit(np.array(e)), max(1, min(MOST_CELLS, len(e), -(-sizes[key[0]] // CELL)))) for key, e in by_label.items()}
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS a label

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for (label, width), own in p.groupby([p["label"], p["embedding"].map(len)], sort=False):
                centre = shared.value.get((label, width))
                if centre is None:  # a length that the sample has not: one cell
                    cells = np.full((len(own), 1), -width)
                else:
                    k = min(SPREAD, len(centre))
                    cells = np.argsort(-(unit(np.stack(own["embedding"].to_numpy())) @ centre.T), axis=1, kind="stable")[:, :k] + width * MOST_CELLS
                yield pd.DataFrame({"label": own["label"].to_numpy(), "rep": own["rep"].to_numpy(), "copies": own["copies"].to_numpy(), "embedding": own["embedding"].to_numpy(), "cells": np.sort(cells, 1).tolist()})

    assigned = write_table(reps.mapInPandas(assign, "label int, rep long, copies long, embedding array<float>, cells array<long>"), "assigned")
    in_cells = assigned.select("label", "rep", "copies", "embedding", "cells", F.explode("cells").alias("cell"))
    blocks = in_cells.groupBy("label", "cell").count().select("label", "cell", F.ceil(F.col("count") / (SHARD / 2)).cast("int").alias("blocks")).withColumn("blocks", F.when(F.col("blocks") <= 2, F.lit(1)).otherwise(F.col("blocks")))
    dealt = in_cells.join(blocks, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Shards of a cell: pairs of blocks. A pair of one block meets in several: it belongs to the one with the next block.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    pair = F.filter(pair, lambda x: (x["i"] != x["j"]) | (F.col("blocks") == 1))
    shards = write_table(dealt.withColumn("p", F.explode(pair)).select("label", "rep", "copies", "embedding", "cells", "cell", "block", "blocks", "p.i", "p.j"), "shards")
    by = ["label", "cell", "i", "j"]

    def build(p: pd.DataFrame) -> pd.DataFrame:
        rep = p["rep"].to_numpy()
        lists = prune(unit(np.stack(p["embedding"].to_numpy()))) if len(p) > 1 else []
        return pd.DataFrame({"rep": rep[: len(lists)], "near": pd.Series([rep[x] for x in lists], dtype=object)})

    graph = shards.groupBy(*by).applyInPandas(build, "rep long, near array<long>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = write_table(graph, "graph")

    def find(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rep").reset_index(drop=True)
        rep, cell, blocks = p["rep"].to_numpy(), int(p["cell"][0]), int(p["blocks"][0])
        v, copies, block = unit(np.stack(p["embedding"].to_numpy())), p["copies"].to_numpy(), p["block"].to_numpy()
        place = pd.Series(np.arange(len(rep)), rep)
        lists = [place.reindex(x if x is not None else []).dropna().astype(int).to_numpy() for x in p["near"]]
        edges = Edges(len(rep), np.repeat(np.arange(len(rep)), [len(x) for x in lists]), np.concatenate(lists))
        edges = join_parts(v, edges, threshold)
        width = max(len(c) for c in p["cells"])
        cells = np.array([[*c, *[-(1 << 40) - i for _ in range(width - len(c))]] for i, c in enumerate(p["cells"])])
        i, j = int(p["i"][0]), int(p["j"][0])
        degree, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for at in range(0, len(rep), QUERIES):
            qi, to = search(v, edges, np.arange(at, min(at + QUERIES, len(rep))), threshold)
            qi = qi + at
            # Links lead both ways too: what one search finds, the other may miss. Each pair once, with the smaller place first.
            ok = qi != to
            qi, to = qi[ok], to[ok]
            first = np.full(len(qi), 1 << 62)
            for x in range(width):
                for y in range(width):
                    same = cells[qi, x] == cells[to, y]
                    first = np.where(same, np.minimum(first, cells[qi, x]), first)
            own = first == cell
            if blocks > 1:  # of a block's own pairs the shard with the next block (the last block: with the first) has them
                inner = block[qi] == block[to]
                home = np.where(block[qi] == blocks - 1, (i == 0) & (j == blocks - 1), (block[qi] == i) & (j == i + 1))
                own &= ~inner | home
            qi, to = qi[own], to[own]
            np.add.at(degree, qi, copies[to])
            unite(root, qi, to)
        return pd.DataFrame({"rep": rep, "n": degree, "head": rep[root]})

    # A task gets about as many rows as a shard has at most: the work is in Python, and Spark would join small partitions.
    tasks = max(1, -(-shards.count() // SHARD))
    found = shards.join(graph, "rep", "left").repartition(tasks, *by).groupBy(*by).applyInPandas(find, "rep long, n long, head long")
    found = write_table(found, "found")
    degrees = found.groupBy("rep").agg(F.sum("n").alias("n"))
    for used in (assigned, shards, graph):
        drop_table(used)
    counted = reps.select("rep", "copies", "least").join(degrees, "rep", "left")
    return classes.select("row", "rep"), counted, found.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`; see link(). Labels are whole numbers.

    n_links: other vectors of the label with a cosine of at least `threshold`, as found. component_id: the least vec_id that
    links reach, itself included. A vector that cannot link, or without a label, has 0 links and is its own component. Rows
    that repeat a vec_id are vectors like any other and link if they can. No rows: no rows.
    """
    rows = write_table(vectors.select("vec_id", "label", "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes, reps, links = link(rows, threshold)
    groups = components(links)
    rooted = reps.join(groups, F.col("rep") == groups.node, "left").select("rep", "copies", "least", "n", F.coalesce("component", "rep").alias("root"))
    told = group_of_equal(rooted, "root", "least", "component_id").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id", "copies")
    told = write_table(told, "classes-told")
    # A class's own first row finds its class by a unique key; the other copies, which may be very many, are dealt by a salt.
    firsts = classes.where("row = rep").join(told, "rep").select("row", "n_links", "component_id")
    many = told.where("copies > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    others = classes.where("row <> rep").withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int")).join(many, ["rep", "_salt"]).select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(firsts.union(others), "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 20) -> float:
    """The share of true links that were found, for the vectors whose id is divisible by `every`, against all rows, in blocks."""
    spark = vectors.sparkSession
    base = valid_vectors(vectors.select("vec_id", "label", "embedding"))
    queries = base.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // 2000))
    true = 0
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        held = spark.sparkContext.broadcast([(r.vec_id, r.label, unit(np.array([r.embedding]))[0]) for r in rows])

        def count(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for p in parts:
                n = 0
                for label, own in p.groupby("label"):
                    q = [x for x in held.value if x[1] == label]
                    if q:
                        hits = unit(np.stack(own["embedding"].to_numpy())) @ np.array([x[2] for x in q]).T >= threshold
                        n += int(hits.sum() - (hits & (own["vec_id"].to_numpy()[:, None] == np.array([x[0] for x in q]))).sum())
                yield pd.DataFrame({"n": [n]})

        true += base.mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = result.where(F.col("vec_id") % every == 0).agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    return found / true if true else 1.0
