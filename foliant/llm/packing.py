"""Documents packed into sequences of a fixed capacity by reciprocal classes, each task on its own.

Class k holds pieces of at most capacity // k tokens, and a sequence of class k holds exactly k of them. Documents may be
cut, so a document gives whole sequences first; of its rest, pieces are cut to the very size of the largest class that
they fill, until what is left wastes next to nothing in its class. When a task's rows end, the few sequences that are
not full are poured into each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow
from .tokens import ids_of

#: The smallest piece that is cut off for an exact fit, and the share of a sequence that a piece may waste uncut.
SMALLEST, WASTE = 64, 0.01
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (class, length) of a document, in its order; their lengths sum to `length`."""
    pieces = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= WASTE * capacity or rest <= SMALLEST:
            pieces.append((k, rest))
            break
        size = capacity // (k + 1)
        pieces.append((k + 1, size))
        rest -= size
    return pieces


class Packer:
    """Sequences of one task. A sequence is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for k, n in cut(total, self.capacity):
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(held) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        """Pour what is left into sequences, one after the other, cutting at their ends."""
        now, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    now.append((doc, start, part, total))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        self.close(now)
                        now, room = [], self.capacity
        if now:
            self.close(now)
        self.open = {}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece of `docs` (doc_id, text; other columns are left alone), with its ids and its place.

    A null text counts as empty: its document is the end id alone. Rows that repeat a doc_id, or have none, are packed each. No rows: no
    pieces. Tasks share nothing and nothing is shuffled; a task that is run again packs its input split the same way. A
    sequence is at most `capacity` long; only the last one of a task is shorter than the classes' rounding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        encode, end = ids_of(tokenizer), int(end_id).to_bytes(4, "little")

        def out() -> pa.RecordBatch:
            doc, start, length, ids, total, seq, offset = zip(*packer.take())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.array(start, "i8")), pa.array(np.array(length, "i8")), pa.array(ids, pa.binary()), pa.array(np.array(total, "i8")), pa.array(np.array(seq, "i8")), pa.array(np.array(offset, "i8"))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc, encode(text) + end)
                if len(packer.rows) >= 2048:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return map_in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, SCHEMA)
