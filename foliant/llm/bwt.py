"""Exact substring dedup by merging Burrows-Wheeler transforms: bytes of long strings that start earlier elsewhere.

Every string of LENGTH bytes is dealt to a task by its content: the least hash of its K-byte grams. A run of strings with the same least hash is a fragment;
equal strings have equal hashes, so all that could be equal meet. Hashes that occur once in the corpus drop out before any text moves. A task gets its
fragments in shards, sorts each shard's suffixes for itself and takes its transform, here the Q bytes before each suffix. The shards are merged by
refining their interleaving: begin with any order, and sort it stably by the transform's symbols; after each round it is sorted by Q bytes more. Where two neighbours
begin to differ is where a common prefix ends, so after LENGTH / Q rounds the blocks are the intervals of strings that repeat. Suffixes of two shards are never compared.
A hash with one text only has nothing to merge, unless the text may repeat within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, write_table

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes of text merged at once, and of one shard.
BATCH, SHARD = 1 << 20, 1 << 18
#: Fragments of one hash beyond which its strings are dealt anew by a second hash.
HOT = 20_000
#: Bytes of a document that are hashed at once.
BLOCK = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_LAST_ID = (1 << 63) - 1


def gram(length: int) -> int:
    """Bytes of the grams whose least hash deals a string: the greatest power of two that is at most half of it."""
    return 1 << max(0, (length // 2).bit_length() - 1)


def _sliding(best: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """The best of each `w` neighbours."""
    n = 1
    while 2 * n <= w:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: x.size - (w - n)], x[w - n :]) if n < w else x


def _grams(text: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of the grams of `k` bytes, a power of two."""
    x = text.astype(np.uint64) + np.uint64(1 + 2 * seed)
    n = 1
    while n < k:
        x = x[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + x[n:]
        n *= 2
    x ^= x >> np.uint64(29 + seed)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _repeats_within(grams: np.ndarray, least: np.ndarray, cut: np.ndarray, w: int) -> np.ndarray:
    """Which runs have their least gram at two places: only those can hold a string twice."""
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), w) == grams)  # where a gram is the least of some string
    value = grams[at]
    two = at[:-1][(value[1:] == value[:-1]) & (np.diff(at) <= w)]
    out = np.zeros(cut.size, bool)
    out[np.searchsorted(cut, np.minimum(two, least.size - 1), side="right") - 1] = True
    return out


def fragments(text: bytes | pa.Buffer, length: int, seed: int = 0, within: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, first string, strings) of the runs of strings with one least hash, and if asked for whether a run may repeat within."""
    data, k = np.frombuffer(text, np.uint8), gram(length)
    w, parts = length - k + 1, []
    for at in range(0, max(0, data.size - length + 1), BLOCK):
        grams = _grams(data[at : at + BLOCK + length - 1], k, seed)
        x = _sliding(np.minimum, grams, w)
        cut = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
        parts.append((x[cut], cut + at, np.diff(cut, append=x.size), *([_repeats_within(grams, x, cut, w)] if within else [])))
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *([np.zeros(0, bool)] if within else []))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _own(docs: DataFrame) -> DataFrame:
    """(doc_id, _d, _h, _text): rows are told apart by id and text. Null ids come last, rows of one id in the order of a hash of their texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def _packed_texts(own: DataFrame) -> DataFrame:
    """(doc_id, _d, _h, _packed): texts compressed one by one, since they are about to be shuffled: a third less than a shuffle's own codec leaves."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 4096, 8 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([z.compress(t) for t in _texts(b, 3)], pa.binary())], ["doc_id", "_d", "_h", "_packed"])

    return own.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(pack, "doc_id long, _d long, _h long, _packed binary")


def _texts(b: pa.RecordBatch, column: int) -> Iterator[pa.Buffer]:
    """A column's texts as buffers, without making strings of them."""
    values = b.column(column)
    values = values.cast(pa.binary() if pa.types.is_string(values.type) else pa.large_binary())
    return (v.as_buffer() for v in values)


# --- which fragments repeat -------------------------------------------------------------------------------------------------------------------------------

FRAGMENTS = "hash long, _d long, _h long, start long, n long"
_FRAGMENT = [("hash", pa.int64()), ("_d", pa.int64()), ("_h", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]
#: A fragment on its way: the low six bytes of its hash (more would only tell apart what may as well meet), a hash of its whole text, whose it is, where, how many strings.
_SENT = np.dtype([("hash", "V6"), ("whole", "<u8"), ("d", "<i8"), ("h", "<i8"), ("start", "<u4"), ("n", "<u4")])
_WITHIN = np.uint32(1 << 31)


def _whole_hashes(text: pa.Buffer, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the fragments' texts, one by one: a text's grams are no proof of the whole."""
    data = memoryview(text)
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + c]) for a, c in zip(at.tolist(), (n + length - 1).tolist())), np.uint64, at.size)


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later) fragments of each text, by document and place. A fragment that is told twice, since its row repeats, counts once."""
    x = x[np.lexsort((x["start"], x["h"], x["d"], x["whole"], x["key"]))]
    new, other = np.ones(x.size, bool), np.ones(x.size, bool)
    new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["whole"][1:] != x["whole"][:-1])
    other[1:] = new[1:] | (x["d"][1:] != x["d"][:-1]) | (x["h"][1:] != x["h"][:-1]) | (x["start"][1:] != x["start"][:-1])
    return x[new], x[other & ~new]


def repeated_fragments(own: DataFrame, length: int) -> DataFrame:
    """`FRAGMENTS` that matter, where they start and their bytes. Without a hash: fragments whose whole text starts earlier too, so that all of it goes. With one: the first of
    each text, if the hash has other texts or the text may repeat within; their strings have to be compared.

    Equal fragments are combined within a batch before anything is shuffled, and what is shuffled are packed columns.
    """
    spark = own.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.rdd.getNumPartitions())

    def told(x: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
        n = (x["n"] & ~_WITHIN).astype(np.int64) + length - 1
        none = pa.nulls(x.size, pa.int64())
        return pa.RecordBatch.from_arrays([none if hashes is None else pa.array(hashes.view(np.int64)), pa.array(x["d"]), pa.array(x["h"]), pa.array(x["start"].astype(np.int64)), pa.array(n)], [c for c, _ in _FRAGMENT])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 16, 8 << 20):
            found = []
            for d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b, 2)):
                hashes, at, n, within = fragments(text, length, within=True)
                x = np.zeros(hashes.size, [*_SENT.descr[1:], ("key", "<u8")])
                x["key"], x["whole"], x["d"], x["h"], x["start"] = hashes & np.uint64((1 << 48) - 1), _whole_hashes(text, at, n, length), d, h, at
                x["n"] = n.astype(np.uint32) | np.where(within, _WITHIN, np.uint32(0))
                found.append(x)
            x = np.concatenate(found) if found else np.zeros(0)
            if not x.size:
                continue
            first, again = _firsts(x)
            part = (first["key"] % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) > 0, [True])))
            out = [(int(part[by[a]]), False, _sent(first[by[a:z]][np.argsort(first['d'][by[a:z]], kind='stable')])) for a, z in zip(cut[:-1], cut[1:])]
            if again.size:  # known already
                out.append((int(again["key"][0] % np.uint64(parts)), True, _sent(again)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out]), pa.array([r[2] for r in out], pa.binary())], ["part", "known", "packed"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for known, packed in zip(b.column(1).to_pylist(), b.column(2)):
                x = _received(packed.as_buffer())
                if known:
                    yield told(x, None)
                else:
                    held.append(x)
        if not held:
            return
        x, again = _firsts(np.concatenate(held))
        yield told(again, None)
        start = np.flatnonzero(np.concatenate(([True], x["key"][1:] != x["key"][:-1])))
        texts = np.diff(start, append=x.size)
        x = x[(np.repeat(texts, texts) > 1) | ((x["n"] & _WITHIN) > 0)]
        yield told(x, x["key"])

    packed = own.select("_d", "_h", "_text").mapInArrow(emit, "part int, known boolean, packed binary")
    return packed.repartition(parts, "part").mapInArrow(tell, FRAGMENTS)


def _sent(x: np.ndarray) -> bytes:
    """Fragments column by column, so that what repeats is found by the shuffle's codec."""
    return x["key"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + b"".join(x[c].tobytes() for c in _SENT.names[1:])


def _received(packed: pa.Buffer) -> np.ndarray:
    size = len(packed) // _SENT.itemsize
    x, at = np.zeros(size, [*_SENT.descr[1:], ("key", "<u8")]), 6 * size
    key = np.zeros((size, 8), np.uint8)
    key[:, :6] = np.frombuffer(packed, np.uint8, at).reshape(-1, 6)
    x["key"] = key.view("<u8")[:, 0]
    for c in _SENT.names[1:]:
        x[c] = np.frombuffer(packed, _SENT[c], size, at)
        at += size * _SENT[c].itemsize
    return x


# --- their texts ------------------------------------------------------------------------------------------------------------------------------------------

SPANS = "_d long, _h long, start long, n long"
_TEXTS = pa.schema([*_FRAGMENT, ("text", pa.binary())])


def _fragment_texts(own: DataFrame, asked: DataFrame, length: int, hot: int) -> DataFrame:
    """The asked fragments and their texts. Those of a hash that has very many are cut again where a second least hash changes, and dealt by both."""
    many = asked.groupBy("hash").count().where(F.col("count") > hot).select("hash", F.lit(True).alias("_many"))
    if not many.isEmpty():
        asked = asked.join(many, "hash", "left")
    else:
        asked = asked.withColumn("_many", F.lit(None).cast("boolean"))
    lists = asked.groupBy("_d", "_h").agg(F.collect_list(F.struct("hash", "start", "n", "_many")).alias("_asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, 4096, 2 << 20):
            rows = []
            for d, h, packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b, 2), b.column(3).to_pylist()):
                data = z.decompress(packed)
                for w in wanted:
                    m, start, n = w["hash"], w["start"], w["n"]
                    if not w["_many"]:
                        rows.append((m, d, h, start, n, data[start : start + n]))
                        continue
                    hashes, at, c = fragments(data[start : start + n], length, seed=1)
                    both = (hashes * np.uint64(_BASE) ^ np.uint64(m % (1 << 64))).view(np.int64)
                    rows += [(x, d, h, start + a, k + length - 1, data[start + a : start + a + k + length - 1]) for x, a, k in zip(both.tolist(), at.tolist(), c.tolist())]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 20_000]), _TEXTS)], schema=_TEXTS)

    joined = _packed_texts(own).drop("doc_id").join(lists, ["_d", "_h"]).select("_d", "_h", "_packed", "_asked")
    return joined.mapInArrow(cut, FRAGMENTS + ", text binary")


def _collapse(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of (hash, id, text's hash, start, bytes, text): equal texts once, the earliest; the others without their text, since all of them repeats."""
    first: dict[bytes, tuple] = {}
    for row in rows:
        held = first.setdefault(row[5], row)
        if held is not row and held[1:4] != row[1:4]:
            late = max(held, row, key=lambda r: r[1:4])
            first[row[5]] = row if late is held else held
            yield (*late[:5], None)
    yield from first.values()


# --- transforms, and their merge --------------------------------------------------------------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each key)."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(keys.size, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return order, rank


def _packed(text: np.ndarray, n: int) -> np.ndarray:
    """The n (at most 8) bytes from each place on, around the end, as one number."""
    x = np.zeros(text.size, np.uint64)
    for i in range(n):
        x = x << np.uint64(8) | np.roll(text, -i)
    return x


def _turned(x: np.ndarray, shards: list[np.ndarray], n: int) -> np.ndarray:
    """Of each place what `x` has n places on, around the end of its shard."""
    at = np.cumsum([0, *(s.size for s in shards)])
    return np.concatenate([np.roll(x[a:z], -n) for a, z in zip(at[:-1], at[1:])])


def step_of(length: int) -> int:
    """Bytes of a symbol: the greatest divisor of the length up to 20."""
    return max(d for d in range(1, 21) if length % d == 0)


def symbols_of(shards: list[np.ndarray], step: int) -> np.ndarray:
    """Dense numbers of the `step` bytes from each place on, in their order, over all shards."""
    n = min(8, step)
    rank = _ranks(np.concatenate([_packed(s, n) for s in shards]))[1]
    while n < step:  # two that overlap make a longer one
        more = min(n, step - n)
        rank, n = _ranks(rank << 32 | _turned(rank, shards, more))[1], n + more
    return rank


def suffix_order(rank: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Where the suffixes of a shard (around its end) start, sorted by their first `depth` bytes or more, given numbers of their first n: by doubling."""
    order, rank = _ranks(rank)
    while n < depth and rank[order[-1]] < rank.size - 1:
        order, rank = _ranks(rank << 32 | np.roll(rank, -n))
        n *= 2
    return order


def merge_transforms(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, new): the suffixes of all shards merged, as places in their concatenation, and which of them begin a block of equal first `length` bytes.

    A shard's transform are its symbols, the `step` bytes before each suffix, in the order of its suffixes. `turn` is the interleaving: whose suffix comes next.
    """
    step = step_of(length)
    symbol = symbols_of(shards, step)
    base = np.cumsum([0, *(s.size for s in shards[:-1])])
    place = np.concatenate([suffix_order(own, step, length) + b for own, b in zip(np.split(symbol, base[1:]), base)])
    transform = _turned(symbol, shards, -step)[place].astype(np.uint32)
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16 if len(shards) < 1 << 16 else np.int64), [s.size for s in shards])
    block, at = np.zeros(turn.size, np.int32), np.arange(turn.size)
    new = np.ones(turn.size, bool)
    for _ in range(length // step):
        asked = transform[at]
        order = np.argsort(asked.astype(np.uint16), kind="stable")
        order = order[np.argsort((asked >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]
        turn, block, asked = turn[order], block[order], asked[order]
        new[1:] = (asked[1:] != asked[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
        at[np.argsort(turn, kind="stable")] = np.arange(turn.size)  # which of its shard's suffixes each turn takes
    return place[at], new


def _shards(texts: list[bytes], size: int) -> list[np.ndarray]:
    out, held, n = [], [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            out.append(np.frombuffer(b"".join(held), np.uint8))
            held, n = [], 0
    return out + ([np.frombuffer(b"".join(held), np.uint8)] if held else [])


def _covered(rows: list[tuple], length: int, shard: int) -> pa.RecordBatch:
    """Spans of the strings in `rows` (fragments of different texts) that start earlier in one of the others, or in itself."""
    _, ids, texts, starts, sizes, data = zip(*rows)
    ids, texts, starts, sizes = (np.array(x, np.int64) for x in (ids, texts, starts, sizes))
    merged, new = merge_transforms(_shards(list(data), shard), length)
    offset = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(offset, sizes)
    _, rank = np.unique(np.rec.fromarrays([ids, texts]), return_inverse=True)
    when = np.repeat(rank.astype(np.int64) << 40 | starts, sizes) + inside
    when[inside > np.repeat(sizes - length, sizes)] = _LAST_ID  # strings that would run over a fragment's end
    ordered = when[merged]
    begin = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ordered, begin), np.diff(np.append(begin, ordered.size)))
    late = np.zeros(ordered.size + 1, np.int8)
    late[merged] = (ordered > least) & (ordered < _LAST_ID)
    edge = np.diff(late, prepend=np.int8(0))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    f = np.searchsorted(offset, a, side="right") - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[f], texts[f], starts[f] + a - offset[f], z - a + length - 1)], ["_d", "_h", "start", "n"])


def _merged(found: DataFrame, length: int, batch: int, shard: int) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            rows = list(_collapse(iter(held)))
            spans = [r[1:5] for r in rows if r[5] is None]
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans)], ["_d", "_h", "start", "n"])
            rows = [r for r in rows if r[5] is not None]
            if rows:
                yield _covered(rows, length, shard)

        for b in slices(batches, 1 << 14, 4 << 20):
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if size >= batch and row[0] != last:
                    yield from close()
                    held, size = [], 0
                held.append(row)
                size, last = size + row[4], row[0]
        if held:
            yield from close()

    return found.repartition("hash").sortWithinPartitions("hash").mapInArrow(merge, SPANS)


# --- the operator -----------------------------------------------------------------------------------------------------------------------------------------


def _spans(own: DataFrame, length: int, batch: int, shard: int, hot: int) -> DataFrame:
    found = write_table(repeated_fragments(own, length), "fragments")
    whole = found.where("hash is null").select("_d", "_h", "start", "n")
    return whole.unionByName(_merged(_fragment_texts(own, found.where("hash is not null"), length, hot), length, batch, shard))


REMOVED = "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, batch: int = BATCH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of each row of `docs` (doc_id, text): its text as UTF-8 without the bytes of strings of `length` bytes that start earlier.

    Earlier is a smaller id, or the same document nearer to its start. Null ids come last; rows of one id are documents of their own, in the order of a hash of
    their texts, and of rows that are the same in both the first counts as earlier. Null texts are empty. `kept` is binary: a cut may fall within a character.
    Other columns don't matter. An empty table gives none.
    """
    own = _own(docs)
    spans = _spans(own, length, batch, shard, hot).groupBy("_d", "_h").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    numbered = _packed_texts(own).withColumn("_copy", F.row_number().over(Window.partitionBy("_d", "_h").orderBy("_d")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, 4096, 4 << 20):
            rows = []
            for doc, copy, packed, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b, 2), b.column(3).to_pylist()):
                data = memoryview(z.decompress(packed))
                if copy > 1 and len(data) >= length:
                    found = [{"start": 0, "n": len(data)}]
                runs: list[list[int]] = []
                for start, n in sorted((s["start"], s["n"]) for s in found or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], start + n)
                    else:
                        runs.append([start, start + n])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((doc, len(data), len(data) - len(kept), len(runs), [{"start": a, "stop": z} for a, z in runs], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", *(c.split()[0] for c in REMOVED.split(", ")[:4]), "kept"])

    joined = numbered.join(spans, ["_d", "_h"], "left").select("doc_id", "_copy", "_packed", "_spans")
    return joined.mapInArrow(cut, f"doc_id long, {REMOVED}, kept binary")
