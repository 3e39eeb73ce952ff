"""Phrase mining against plain counting: passes with few and with saturated buckets, odd tables, exact large products."""

import random
import re
from collections import Counter

import pytest

from foliant.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string"


def plainly(rows, longest, least, top):
    """The collocations of (lang, text) rows, every phrase counted."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    found = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    for (lang, words), a in found.items():
        if any(b >= a and len(w) > len(words) and o == lang and any(w[i : i + len(words)] == words for i in range(len(w))) for (o, w), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, total, -score))
    return ranked


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    words = ["The", "the", "cat", "ça", "DOG", "a", "b", "Éa", "x y", "q", "\x00", "q\x00", "fifteen-letters", "sixteen-letters!", "a-word-of-twenty-four-.", "a-word-of-many-more-than-twenty-four-bytes", "z-z"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "; ", "?!"]) for _ in range(n))
    made = [(random.choice(["en", "fr", None, "und"]), text(random.choice([0, 1, 5, 80]))) for _ in range(60)]
    made += [("en", None), ("fr", ""), ("en", "...!!"), (None, "a a a a a a a a a a a a a a a"), ("de", "one two three four five six " * 30)] + [("fr", "the same row, twice")] * 6
    return made


@pytest.mark.parametrize(("bits", "least"), [(3, 4), (12, 4), (20, 300), (17, 6)])
def test_equals_counting(spark, rows, bits, least):
    """Three bits: every bucket is full, so that only exact counts decide. Counts over 255 take wider buckets."""
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, (lang, t) in enumerate(rows * (60 if least > 255 else 1))], DOCS).repartition(3)
    found = sorted(tuple(r) for r in phrases.mine(docs, least=least, top=15, bits=bits).collect())
    assert found == sorted(plainly(rows * (60 if least > 255 else 1), 5, least, 15)) and found


def test_empty_and_rare(spark, rows):
    none = spark.createDataFrame([], DOCS)
    assert phrases.mine(none, bits=10).count() == 0
    few = spark.createDataFrame([(1, "seen once only", None, "")], DOCS)
    assert phrases.mine(few, least=2, bits=10).count() == 0


def test_products_past_64_bits(spark):
    """floor(1000 a n / (l r)) in whole numbers, where doubles and longs both fail."""
    big = 10**15 + 7
    every = spark.createDataFrame([("en", 1, "a", 3 * big + 1), ("en", 1, "b", 5 * big + 2), ("en", 2, "a b", big)], "lang string, k int, phrase string, n long")
    row = phrases.collocations(every, spark.createDataFrame([("en", 10**16 + 9)], "lang string, n long")).first()
    assert row.score == 1000 * big * (10**16 + 9) // ((3 * big + 1) * (5 * big + 2))


def test_ties_and_cuts(spark):
    """Equal scores after flooring take the smallest cut; equal phrases rank by bytes."""
    every = [("en", 1, w, 100) for w in ("a", "b", "c", "é", "f")] + [("en", 2, p, 50) for p in ("b c", "f é", "é f")] + [("en", 2, "a b", 50), ("en", 3, "a b c", 40)]
    rows = phrases.collocations(spark.createDataFrame(every, "lang string, k int, phrase string, n long"), spark.createDataFrame([("en", 1000)], "lang string, n long")).orderBy("rank").collect()
    assert [r.phrase for r in rows] == ["a b c", "a b", "b c", "f é", "é f"]
    assert (rows[0].l, rows[0].r, rows[0].score) == (100, 50, 8000)
