"""Conversation repair against plain searches, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from foliant.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, edits, repaired) of rows (role, text, truncated, must go): every edit of every row tried, from each prefix of what was built."""
    may_follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, last, inserted):
        best = []
        if i == len(rows) and last in ("", "a"):
            best.append((0, "", ()))
        if inserted < 3:
            for c in "ua":
                if c in may_follow[last]:
                    cost, edits, out = rest(i, c, inserted + 1)
                    best.append((cost + 3, "I" + edits, ((c, ""),) + out))
        if i < len(rows):
            role, text, truncated, must = rows[i]
            cost, edits, out = rest(i + 1, last, 0)
            best.append((cost + 4, "D" + edits, out))
            if not must:
                for edit, c, more in [("K", role[:1], 0), ("R", "u", 3), ("R", "a", 3)]:
                    if c and c in may_follow[last]:
                        cost, edits, out = rest(i + 1, c, 0)
                        best.append((cost + more + 3 * truncated, edit + edits, ((c if edit == "R" else role, text),) + out))
        return min(best, key=lambda b: b[:2], default=(10**9, "", ()))

    return rest(0, "", 0)


def test_scan_equals_every_way():
    random.seed(5)
    machine = repair.Determinised()
    for n in (*range(6), *[8] * 150, *[14] * 40):
        rows = [(random.choice(["system", "user", "assistant", "tool", ""]), str(i), random.random() < 0.3, random.random() < 0.2) for i in range(n)]
        symbols = bytes(repair.symbol(r[:1], t, m) for r, _, t, m in rows)
        cost, edits, out = cheapest(tuple(rows))
        assert machine.scan(symbols) == (cost, edits)
        assert LEGAL.match("".join(r[:1] for r, _ in out))
    assert len(machine.vectors) < 100 and len(machine.moves) <= 9 * len(machine.vectors)


def plainly(rows):
    """The query's columns for (conv_id, turn, role, text) rows, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
            kept += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, edits = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in kept:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            edits.append((role, text, fault == "truncated", fault in ("blank", "duplicate")))
        turns = [t for t, *_ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, rows_left = cheapest(tuple(edits))
        full = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{full.get(r, r)}:{t}" for r, t in rows_left)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, cost string"


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(11)
    said = ["Yes.", "No", "", "  \t", None, "A long one " * 50 + "!", "Yes.", "énd。", "x.\n"]
    rows = [(random.choice([1, 2, 3, None, -7]), random.choice([None, *range(12)]), random.choice(["user", "assistant", "system", "User", "", None, "ua"]), random.choice(said), "clash") for _ in range(70)]
    rows += [(i, t, r, "Well.", "clash") for i in range(100, 160) for t, r in enumerate(["system", "user", "assistant", "user"])] + [(5, 1, "user", "Same.", "clash")] * 4
    return rows


def test_query_equals_plain(spark, odd):
    df = spark.createDataFrame(odd, CONV).repartition(3)
    found = {r[0]: tuple(r)[1:] for r in repair.audit(repair.damage(df)).collect()}
    assert found == plainly([r[:4] for r in odd])


def test_repaired_rows_are_legal(spark, odd):
    made = repair.repair(spark.createDataFrame(odd, CONV))
    rows = made.orderBy("conv_id", "no").collect()
    for conv in {r.conv_id for r in rows}:
        own = [r for r in rows if r.conv_id == conv]
        assert LEGAL.match("".join(r.role[:1] for r in own)) and [r.no for r in own] == list(range(len(own)))


def test_empty_table(spark):
    none = spark.createDataFrame([], CONV)
    assert repair.audit(repair.damage(none)).count() == 0 and repair.repair(none).count() == 0


def test_a_long_conversation(spark):
    """A byte for each row is held, and the edits are found in one scan."""
    many = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Row "), "id", F.when(F.col("id") % 1000 == 7, "").otherwise(".")).alias("text"))
    row = repair.audit(many.withColumn("copy", F.lit(0))).first()
    assert (row.truncated, row.cost, row.illegal, row.audit) == (20, 60, 0, "K" * 20_000)
