"""Conversation structure repair: the cheapest edits that make a conversation's roles legal, by lazy weighted determinisation.

A conversation is legal when its role initials are `(s?(ua)+)?`. Edits keep, rerole, delete or insert rows, each at a cost; the automaton of edits is nondeterministic
and weighted. Its determinisation is built while it is needed: a state is a vector of costs, one for each state of the grammar, less their least; what a symbol
does to it is computed once and then looked up. One scan over a conversation's symbols gives the cost; tight arcs, marked from the end backwards, give the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_in_arrow, write_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar: state 0 begins, 1 follows s, 2 follows u, 3 follows a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: Roles that an edit can give, by their initials.
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 40
INITIALS = "sua"
MUST_GO = 8

BLANK = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"


def symbol(initial: str, truncated: bool, must_go: bool) -> int:
    """What the automaton reads of a row: its initial (s, u, a, other), whether it is truncated, whether it must go."""
    known = INITIALS.find(initial) if initial else -1
    return MUST_GO if must_go else (known if known >= 0 else 3) * 2 + truncated


@lru_cache(maxsize=None)
def arcs(sym: int) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edit) of every edit of a row with this symbol."""
    out = [(p, p, DELETE, "D") for p in range(4)]
    if sym != MUST_GO:
        more = TRUNCATED * (sym & 1)
        out += [(p, STEP[p, c], KEEP + more, "K") for p in range(4) for c in "sua?"[sym >> 1] if (p, c) in STEP]
        out += [(p, STEP[p, c], REROLE + more, "R") for p in range(4) for c in ROLES if (p, c) in STEP]
    return tuple(out)


INSERTS = tuple((p, STEP[p, c]) for p in range(4) for c in ROLES if (p, c) in STEP)


def _inserted(costs: list[int]) -> list[int]:
    """The costs once rows may be inserted: a round for each state is enough."""
    for _ in range(4):
        for p, q in INSERTS:
            costs[q] = min(costs[q], costs[p] + INSERT)
    return costs


class Determinised:
    """The deterministic automaton as far as it has been needed. Inserts and deletes bound how far two costs of a vector can lie apart, so its states are few."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.start = self._number(_inserted([0, FAR, FAR, FAR]))[0]

    def _number(self, costs: list[int]) -> tuple[int, int]:
        # what is strictly worse than going on from state 3 leads to no best path: it can do what states 0 and 1 can, but for an s, which it can delete
        far = (costs[0] > costs[3] + DELETE, costs[1] > costs[3], False, False)
        least = min(costs)
        vector = tuple(FAR if f or c >= FAR else c - least for f, c in zip(far, costs))
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def move(self, state: int, sym: int) -> tuple[int, int]:
        """The next state and what was taken off its costs."""
        if (state, sym) not in self.moves:
            vector, costs = self.vectors[state], [FAR] * 4
            for p, q, w, _ in arcs(sym):
                costs[q] = min(costs[q], vector[p] + w)
            self.moves[state, sym] = self._number(_inserted(costs))
        return self.moves[state, sym]

    def _with_inserts(self, state: int, mask: int) -> int:
        """The marked states of a layer, and those that a tight insert leads to them from."""
        v = self.vectors[state]
        for _ in range(4):
            for p, q in INSERTS:
                if mask >> q & 1 and v[p] + INSERT == v[q]:
                    mask |= 1 << p
        return mask

    def _before(self, state: int, sym: int, mask: int) -> int:
        """The marked states before a row, given those after it."""
        if (state, sym, mask) not in self.marks:
            after, off = self.move(state, sym)
            v, w = self.vectors[state], self.vectors[after]
            tight = 0
            for p, q, cost, _ in arcs(sym):
                if mask >> q & 1 and v[p] < FAR and v[p] + cost == w[q] + off:
                    tight |= 1 << p
            self.marks[state, sym, mask] = self._with_inserts(state, tight)
        return self.marks[state, sym, mask]

    def scan(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of the edits, and of the edits that cost so little the ASCII-least string of their initials."""
        states, total = [self.start], 0
        for sym in symbols:
            state, off = self.move(states[-1], sym)
            states.append(state)
            total += off
        last = self.vectors[states[-1]]
        best = min(last[q] for q in ENDS)
        masks = [0] * len(states)
        masks[-1] = self._with_inserts(states[-1], sum(1 << q for q in ENDS if last[q] == best))
        for i in range(len(symbols) - 1, -1, -1):
            masks[i] = self._before(states[i], symbols[i], masks[i + 1])
        return total + best, "".join(self._read(symbols, states, masks, best))

    def _read(self, symbols: bytes, states: list[int], masks: list[int], best: int) -> Iterator[str]:
        """Along marked tight arcs, the least edit first; state and edit give the next state, so nothing has to be tried."""
        at, q = 0, 0
        while True:
            v = self.vectors[states[at]]
            if at == len(symbols) and q in ENDS and v[q] == best:
                return
            ways = [("I", at, t) for p, t in INSERTS if p == q and masks[at] >> t & 1 and v[q] + INSERT == v[t]]
            if at < len(symbols):
                after, off = self.move(states[at], symbols[at])
                w = self.vectors[after]
                ways += [(e, at + 1, t) for p, t, cost, e in arcs(symbols[at]) if p == q and masks[at + 1] >> t & 1 and v[q] + cost == w[t] + off]
            edit, at, q = min(ways)
            yield edit


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows after a planned damage by crc32(`conv_id:turn`) % 20, for tests of the repair.

    0 drops a row (it stays, its copy null, so that its conversation is known), 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes its role user.
    Null ids and turns count as a space in the sum, null roles and texts are a space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).cast("int")
    role = F.when(how == 4, "user").otherwise(space("role"))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(how == 0, F.array().cast("array<int>")).when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode_outer(copies).alias("copy"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with `fault`: 1 blank, 2 duplicate (its role and text came before), 3 truncated, 0 none."""
    order = [F.col("turn").asc_nulls_first(), F.col("copy")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("copy").isNull()).orderBy(*order)) > 1
    ends = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = F.when(~F.col("text").rlike(BLANK), 1).when(seen, 2).when(~ends.isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumn("fault", fault)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ORDER = ["_kind", "turn", "role", "text", "copy"]


EDITS = pa.schema([("conv_id", pa.int64()), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ORDER])


def _conversations(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, tuple]]:
    """(first of its conversation, row) for rows that come sorted by conversation."""
    last: object = object()
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names)):
            yield row[0] != last, row
            last = row[0]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: its counts, cost and edits. Of a row, one byte is held until its conversation ends."""
    machine, out, now = Determinised(), [], None

    def close(c: dict) -> tuple:
        cost, audit = machine.scan(bytes(c["symbols"]))
        gaps = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
        return c["id"], gaps, *c["faults"][1:], c["illegal"], cost, audit

    for first, (conv, turn, role, copy, fault) in _conversations(batches, ["conv_id", "turn", "role", "copy", "fault"]):
        if first:
            if now:
                out.append(close(now))
            now = {"id": conv, "symbols": bytearray(), "faults": [0, 0, 0, 0], "illegal": 0, "low": 0, "high": 0, "turns": 0, "before": None}
        if len(out) >= 2000:
            yield _batch(out, EDITS)
            out = []
        if copy is None:
            continue
        if turn is not None and (not now["turns"] or turn != now["high"]):
            now["low"], now["high"], now["turns"] = now["low"] if now["turns"] else turn, turn, now["turns"] + 1
        now["faults"][fault] += 1
        now["illegal"] += now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au")
        now["before"] = role[:1]
        now["symbols"].append(symbol(role[:1], fault == 3, fault in (1, 2)))
    if now:
        out.append(close(now))
    if out:
        yield _batch(out, EDITS)


def _applied(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(None, (conv_id, *`names`)) where a conversation begins, then (role, text) of its repaired rows. Its edits come before its rows."""
    edits, at, state = "", 0, 0

    def given() -> str:
        return "a" if state == 2 else "u"

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at += 1
            yield ROLES[given()], ""
            state = STEP[state, given()]

    for _, (conv, kind, role, text, copy, *found) in _conversations(batches, ["conv_id", "_kind", "role", "text", "copy", *names]):
        if kind == 0:
            yield None, (conv, *found)
            edits, at, state = found[-1], 0, 0
            yield from inserts()
        elif copy is not None:
            edit, at = edits[at], at + 1
            if edit != "D":
                yield role if edit == "K" else ROLES[given()], text
                state = STEP[state, role[0] if edit == "K" else given()]
            yield from inserts()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, no, role, text) of the repaired conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, held, conv, no = [], 0, None, 0
    for role, row in _applied(batches, ["audit"]):
        if role is None:
            conv, no = row[0], 0
            continue
        out.append((conv, no, role, row))
        no, held = no + 1, held + len(row)
        if len(out) >= 1000 or held > 4 << 20:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's counts and edits, and the sum of its repaired rows, which is fed row by row."""
    schema = pa.schema([*EDITS, ("repaired_sha256", pa.string())])
    out, now, total, between = [], None, hashlib.sha256(), ""
    for role, row in _applied(batches, EDITS.names[1:]):
        if role is not None:
            total.update(f"{between}{role}:{row}".encode())
            between = "\n"
            continue
        if now:
            out.append((*now, total.hexdigest()))
        now, total, between = row, hashlib.sha256(), ""
        if len(out) >= 2000:
            yield _batch(out, schema)
            out = []
    if now:
        yield _batch([*out, (*now, total.hexdigest())], schema)


def find_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their faults, one row a conversation with `RESULT`), of `rows` (conv_id, turn, role, text, copy); a null copy marks a row that is not there.

    Rows count in the order of turn (nulls first), role, text. Null roles and texts are a space, null ids are one conversation. A conversation is read by
    one task as a stream: it holds a byte for each row. Whether a row repeats an earlier one is found by a window over (conversation, role, text).
    """
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.col("copy").cast("int").alias("copy"))
    faulty = write_table(_faults(known).withColumn("_kind", F.lit(1)), "faults")
    return faulty, map_in_arrow(_in_order(faulty), _edits, "conv_id long, " + RESULT)


def _marked(faulty: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows, each conversation's edits before them."""
    return _in_order(faulty.drop("fault").unionByName(edits.withColumn("_kind", F.lit(0)), allowMissingColumns=True))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, no, role, text): the repaired conversations of `rows` (conv_id, turn, role, text). Other columns are left out; empty tables give none.

    One edit string of all that cost least: see find_edits() for the order of rows and for nulls.
    """
    faulty, edits = find_edits(rows.select("conv_id", "turn", "role", "text", F.lit(0).alias("copy")))
    return map_in_arrow(_marked(faulty, edits), _repaired, "conv_id long, no long, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `rows` (conv_id, turn, role, text, copy).

    The sum is that of the repaired rows as `role:text`, by lines; it is sequential, so one task feeds it, a row at a time. A conversation of which nothing
    is left has zeros, no edits and the sum of nothing.
    """
    faulty, edits = find_edits(rows)
    return map_in_arrow(_marked(faulty, edits), _digested, "conv_id long, " + RESULT + ", repaired_sha256 string")
