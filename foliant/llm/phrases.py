"""Phrase collocations by hash buckets (PCY and DHP): each pass counts the phrases of one length and, in buckets, those that are a word longer.

What is broadcast has a fixed size: one bit for each bucket of the next length, and one for each bucket that holds a frequent phrase of the length before.
A phrase is counted exactly only if its bucket can be frequent and so can both phrases that it is made of (Apriori). Counts are exact: buckets only say
what need not be counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, slices, write_table

#: Longest phrase in words; least occurrences; phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Buckets (a power of two), and buckets that one row of counts holds.
BITS, SLICE_BITS = 23, 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What a byte is: of a word (0), between words (1), between pieces (2).
_KIND = np.array([2 if c in b".,;:!?\n\x0b\x0c\r" else 1 if c in b" \t" else 0 for c in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

PARTIAL = "lang string, n long, slice int, counts binary, phrases array<string>, times array<long>"
_SCHEMA = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("phrases", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


class Words:
    """The words of one language's texts: where they are, the piece each is of, and two numbers that tell words apart.

    Words of up to 15 bytes are told apart by those bytes and their count, longer ones by two hashes of 64 bits.
    """

    def __init__(self, text: bytes, lang: str) -> None:
        self.raw = text.translate(_LOWER) + bytes(24)
        kind = _KIND[np.frombuffer(self.raw, np.uint8)]
        kind[-24:] = 2
        inside = np.empty(kind.size + 1, bool)
        inside[0], inside[1:] = False, kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        size = self.stop - self.start
        eight = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        self.first = eight[self.start] & _MASK[np.minimum(size, 8)]
        self.second = eight[self.start + 8] & _MASK[np.clip(size - 8, 0, 8)] | (np.minimum(size, 15) << 56).astype(np.uint64)
        for i in np.flatnonzero(size > 15):
            word = self.raw[self.start[i] : self.stop[i]]
            self.first[i], self.second[i] = xxhash.xxh64_intdigest(word) | 0xFF << 56, xxhash.xxh64_intdigest(word, 1)  # no text has the byte 255
        self.hash = _longer(self.first, self.second) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def phrase(self, at: int, k: int) -> str:
        return b" ".join([self.raw[a:z] for a, z in zip(self.start[at : at + k].tolist(), self.stop[at : at + k].tolist())]).decode()

    def counted(self, at: np.ndarray, k: int, grams: np.ndarray) -> Iterator[tuple[str, int]]:
        """(phrase, times) of the `k` words from each place, `grams` being their hashes; words are compared, so that equal hashes alone count for nothing."""
        order = np.argsort(grams)
        at, grams = at[order], grams[order]
        new = np.concatenate(([True], grams[1:] != grams[:-1]))
        for j in range(k):
            for c in (self.first, self.second):
                word = c[at + j]
                differs = (word[1:] != word[:-1]) & ~new[1:]
                if differs.any():  # two phrases of one hash: their places may alternate, which their sum by phrase puts right
                    new[1:] |= differs
        cut = np.flatnonzero(new)
        for i, n in zip(at[cut].tolist(), np.diff(cut, append=at.size).tolist()):
            yield self.phrase(i, k), n


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of phrases with one more word."""
    x = phrase * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sliced(counts: np.ndarray, least: int) -> Iterator[tuple]:
    """Rows of the buckets that aren't empty; counts stop at `least`, which is all that matters."""
    kind = np.min_scalar_type(least)
    for i, part in enumerate(counts.reshape(-1, min(counts.size, 1 << SLICE_BITS))):
        if part.any():
            yield None, None, i, np.minimum(part, least).astype(kind).tobytes(), None, None


def _batches(rows: Iterator[tuple], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def _pass(docs: DataFrame, k: int, longest: int, least: int, bits: int, frequent: bytes | None, possible: bytes | None) -> DataFrame:
    """Exact counts of the candidates of `k` words, by language and hash; and bucket counts of k + 1 words. With k = 0 the words of each language and the buckets of words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, possible))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8)).view(bool)
        earlier, own = (as_bits(b) if b else None for b in sent.value)
        ahead = np.zeros(1 << bits, np.uint32) if k < longest else None
        held: Counter = Counter()

        def one(lang: str, texts: list[str]) -> None:
            words = Words("\n".join(texts).encode(), lang)
            h, piece = words.hash, words.piece
            if k == 0:
                np.add.at(ahead, _buckets(h, bits), np.uint32(1))
                held[lang, None] += h.size
                return
            if h.size < k:
                return
            if k == 1:
                grams, on = h, own[_buckets(h, bits)]
            else:
                shorter = h
                for j in range(1, k - 1):
                    shorter = _longer(shorter[:-1], h[j:])
                ok = earlier[_buckets(shorter, bits)]
                on = ok[:-1] & ok[1:] & (piece[k - 1 :] == piece[: piece.size - k + 1])
                grams = _longer(shorter[:-1], h[k - 1 :])
                at = np.flatnonzero(on)
                on[at] = own[_buckets(grams[at], bits)]
            if k < longest and h.size > k:
                more = np.flatnonzero(on[:-1] & on[1:] & (piece[k:] == piece[: piece.size - k]))
                np.add.at(ahead, _buckets(_longer(grams[more], h[more + k]), bits), np.uint32(1))
            at = np.flatnonzero(on)
            for phrase, n in words.counted(at, k, grams[at]) if at.size else ():
                held[lang, phrase] += n

        def told() -> Iterator[tuple]:
            by: dict[tuple, tuple[list, list]] = {}
            for (lang, phrase), n in held.items():
                if phrase is None:
                    yield lang, n, None, None, None, None
                else:
                    names, times = by.setdefault((lang, xxhash.xxh32_intdigest(phrase.encode()) % parts), ([], []))
                    names.append(phrase)
                    times.append(n)
            for (lang, part), (names, times) in by.items():
                yield lang, None, part, None, names, times
            held.clear()

        def rows() -> Iterator[tuple]:
            for b in slices(batches, 1 << 16, 4 << 20):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    one(lang, texts)
                if len(held) > 200_000:
                    yield from told()
            yield from told()
            if ahead is not None:
                yield from _sliced(ahead, least)

        return _batches(rows())

    return write_table(docs.mapInArrow(count, PARTIAL), f"phrases{k}")


def _summed(partial: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases whose counts come to `least`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            for lang, names, times in zip(*(b.column(i).to_pylist() for i in range(3))):
                for phrase, n in zip(names, times):
                    sums[lang, phrase] += n
        rows = [(lang, phrase, n) for (lang, phrase), n in sums.items() if n >= least]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 10_000])], ["lang", "phrase", "n"])

    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.where("phrases is not null").select("lang", "phrases", "times", "slice").repartition(parts, "slice").mapInArrow(add, "lang string, phrase string, n long")


def _bitmap(counts: DataFrame, least: int, bits: int) -> bytes:
    """One bit for each bucket: whether its counts come to `least`. The driver gets 2^bits / 8 bytes in all, whatever the table."""
    kind, size = np.min_scalar_type(least), min(1 << bits, 1 << SLICE_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, own in zip(b.column(0).to_pylist(), b.column(1)):
                sums[i] = sums.get(i, np.zeros(size, np.uint64)) + np.frombuffer(own.as_buffer(), kind)
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["slice", "bits"])

    found = counts.where("counts is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, bits binary").collect()
    parts = {r["slice"]: bytes(r["bits"]) for r in found}
    return b"".join(parts.get(i, bytes(-(-size // 8))) for i in range((1 << bits) // size))


def _marked(frequent: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """The buckets of frequent phrases of `k` words, as counts of `least`."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                h = Words("\n".join(phrases).encode(), lang).hash
                gram = h[::k]
                for j in range(1, k):
                    gram = _longer(gram, h[j::k])
                counts[_buckets(gram, bits)] = least
        return _batches(_sliced(counts, least))

    return frequent.select("lang", "phrase").mapInArrow(mark, PARTIAL)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, n) of all phrases of 1 to `longest` words that occur `least` times or more, (lang, n) of all words), of `docs` (lang, text).

    A-Z are lower-cased; `.,;:!?` and line ends part pieces, space and tab part words. Null languages are `und`, null texts are empty. Rows repeat: they count.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partial = _pass(own, 0, longest, least, bits, None, None)
    words = write_table(partial.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    possible, frequent, found = _bitmap(partial, least, bits), None, []
    drop_table(partial)
    for k in range(1, longest + 1):
        partial = _pass(own, k, longest, least, bits, frequent, possible)
        kept = write_table(_summed(partial, least).select("lang", F.lit(k).alias("k"), "phrase", "n"), "frequent")
        found.append(kept)
        if k < longest:
            possible = _bitmap(partial, least, bits)
            frequent = _bitmap(_marked(kept, k, least, bits), least, bits)
        drop_table(partial)
    return reduce(DataFrame.unionByName, found), words


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def collocations(every: DataFrame, words: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases, of frequent_phrases().

    A phrase's score is that of its worst cut, floor(1000 a n / (l r)), of equal ones the first. A phrase goes when a longer one that holds it occurs as
    often. Ranks go by score, a (both falling), phrase. Products are decimals of 38 digits: counts of less than 10^17 can't overflow.
    """
    found = every.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    counts = every.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    side = lambda name: counts.select("lang", F.col("_part").alias(f"_{name}"), F.col("_n").alias(name))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("_l"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_r"))
    cuts = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"]).join(words, "lang")
    score = F.expr("cast(cast(1000 * cast(a as decimal(17,0)) as decimal(20,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    worst = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    # the phrases within a phrase
    inner = found.where("k >= 3").withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_k") + 1)))
    held = inner.groupBy("lang", _part(F.col("_at"), F.col("_k")).alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = worst.join(held, ["lang", "phrase"], "left").where("_longer is null or _longer < a")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The collocations of `docs` (lang, text); other columns don't matter, an empty table gives no rows."""
    return collocations(*frequent_phrases(docs, longest, least, bits), top)
