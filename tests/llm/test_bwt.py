"""Repeated strings by merged transforms, against plain searches."""

import hashlib
import random

import numpy as np
import pytest

from foliant.llm import bwt

DOCS = "doc_id long, text string, start string, n_bytes string"


@pytest.mark.parametrize("length", [7, 10, 20, 60, 100])
def test_merge_sorts_suffixes(length):
    """Blocks of the merged transforms are the suffixes with equal beginnings, in order, however many shards there are."""
    random.seed(length)
    words = [bytes(random.choices(b"ab\x00", k=random.choice([3, 7, 30]))) for _ in range(8)]
    texts = [b"".join(random.choices(words, k=60)) for _ in range(9)]
    for size in (300, 1000, 1 << 20):
        shards = bwt._shards(texts, size)
        merged, new = bwt.merge_transforms(shards, length)
        plain = [((bytes(s) * (2 + length // len(s)))[i : i + length]) for s in shards for i in range(len(s))]
        found = [plain[p] for p in merged]
        assert found == sorted(plain)
        assert new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_equal_strings_meet():
    """The least hash of a string depends on the string alone, also where a text is hashed in blocks."""
    random.seed(1)
    text = bytes(random.choices(range(256), k=3000))
    hashes, at, n = bwt.fragments(text, 100)
    assert at.tolist() == np.cumsum([0, *n[:-1]]).tolist() and n.sum() == 2901
    for a in (0, 17, 1500, 2900):
        own = bwt.fragments(text[a : a + 100], 100)
        assert own[0][0] == hashes[np.searchsorted(at, a, side="right") - 1]
    block, bwt.BLOCK = bwt.BLOCK, 512
    try:
        parts = bwt.fragments(text, 100)
        assert parts[2].sum() == 2901 and np.array_equal(np.repeat(parts[0], parts[2]), np.repeat(hashes, n))
    finally:
        bwt.BLOCK = block


def plainly(rows, length):
    """(doc_id, bytes, removed, spans, sum of what is left) of (doc_id, text) rows, sorted."""
    out, seen = [], set()
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(data[i : i + length])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, rows, length, **sizes):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS).repartition(5)
    made = bwt.remove_repeats(docs, length, **sizes).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in made), key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(2)
    word = lambda: "".join(random.choices("abcdé ", k=random.randint(2, 9)))
    passages = [" ".join(word() for _ in range(random.choice([8, 20, 40, 90]))) for _ in range(12)]
    made = []
    for i in range(120):
        parts = [random.choice(passages) if random.random() < 0.5 else " ".join(word() for _ in range(random.choice([1, 10, 60]))) for _ in range(random.randint(0, 6))]
        made.append((i, " ".join(parts)))
    copies = [(200 + i, made[i % 3][1]) for i in range(30)]  # copies of whole documents
    edited = [(300 + i, made[5][1][: 40 * i] + "X" + made[5][1][40 * i :]) for i in range(12)]
    return made + copies + edited + [(400, "a" * 700), (401, "ab" * 300 + "a" * 130), (402, "abc" * 50), (403, None), (404, ""), (405, "é" * 90)]


@pytest.mark.parametrize("sizes", [{}, {"batch": 4000, "shard": 700}, {"batch": 2000, "shard": 300, "hot": 3}])
def test_equals_plain(spark, rows, sizes):
    assert found(spark, rows, 100, **sizes) == sorted(plainly(rows, 100), key=str)


def test_other_lengths(spark, rows):
    assert found(spark, rows[:60], 30) == sorted(plainly(rows[:60], 30), key=str)


def test_a_common_passage_in_one_batch_of_many_contexts(spark):
    """One passage in every document, each time in other surroundings: its fragments are many, and are dealt anew."""
    random.seed(8)
    passage = "".join(random.choices("abcdefgh", k=160))
    rows = [(i, "".join(random.choices("ijkl", k=130)) + passage + "".join(random.choices("mnop", k=130))) for i in range(150)]
    got = found(spark, rows, 100, batch=5000, shard=1000, hot=20)
    assert got == sorted(plainly(rows, 100), key=str)
    assert sum(r[2] > 0 for r in got) == 149


def test_odd_rows(spark):
    """Rows of one id are documents of their own; of rows that are the same the first counts as earlier; null ids come last."""
    a, b = "0123456789" * 12 + "a", "9876543210" * 12 + "b"
    made = found(spark, [(1, a), (1, a), (1, b), (None, a), (None, None), (7, None), (0, b + a)], 100)
    gone = {}
    for r in made:
        gone.setdefault(r[0], []).append(r[2])
    assert gone[7] == [0] and sorted(gone[None]) == [0, 121]
    assert sum(gone[1]) == 121 * 3 and gone[0] == [plainly([(0, b + a)], 100)[0][2]]
    assert bwt.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert found(spark, [(1, a), (1, a)], 100) == sorted(plainly([(1, a), (1, a)], 100), key=str)
    # periods of which the second string begins within the first, and just after it
    for period in (1, 2, 7, 69, 70, 99, 100, 101, 140):
        unit = "".join(random.Random(period).choices("abcdefghij", k=period))
        rows = [(1, "xy" + (unit * 300)[: 100 + period + 3] + "z"), (2, "".join(random.Random(1).choices("klm", k=150)))]
        assert found(spark, rows, 100) == sorted(plainly(rows, 100), key=str)
