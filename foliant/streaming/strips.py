"""Strips that arrive as a stream of rows: tiles as soon as they are complete, by state for each book."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.strips import _ROW, FEATURES, TILES, Cutter, Panel, as_rows


class _Books(StatefulProcessor):
    """A book's state: rows that no tile has yet, in pieces of a list of which the front goes; where they begin and how the book stands; rows that came too early."""

    def __init__(self, panel: Panel) -> None:
        self.panel = panel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "rows binary")
        self.stands = handle.getValueState("stands", "first long, opening boolean, resumed boolean, tiles int, spare binary, next long, last long")
        self.over = handle.getValueState("over", "over boolean")
        self.early = handle.getValueState("early", "rows binary")

    def _load(self) -> tuple[Cutter, int, int]:
        if not self.stands.exists():
            return Cutter(self.panel), 0, -1
        first, opening, resumed, tiles, spare, following, last = self.stands.get()
        rows = np.concatenate([np.zeros(0, _ROW), *(np.frombuffer(r[0], _ROW) for r in self.held.get())])
        return Cutter(self.panel, rows, first, opening, resumed, tiles, pickle.loads(spare)), following, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        if self.over.exists():
            return
        cutter, following, last = self._load()
        early = pickle.loads(self.early.get()[0]) if self.early.exists() else {}
        before, held, waited = cutter.first, len(cutter.rows), len(early)
        for part in rows:
            last = max(last, *(int(r) for r in part.loc[part["ended"], "row"])) if part["ended"].any() else last
            for r in part.itertuples(index=False):
                if r.row >= following:  # a row that was cut already came again
                    early[int(r.row)] = (int(r.lo), int(r.hi), float(r.busy), bool(r.paper), int(r.ink))
        out, ready = [], []
        while following in early:
            ready.append(early.pop(following))
            following += 1
        if early or waited:
            self.early.update((pickle.dumps(early),))
        for at in range(0, len(ready), self.panel.height):
            out += cutter.feed(as_rows(dict(zip(_ROW.names, zip(*ready[at : at + self.panel.height])))))
        if last >= 0 and following > last:
            out += cutter.finish()
            self.held.clear()
            self.stands.clear()
            self.early.clear()
            self.over.update((True,))
        else:
            if cutter.first > before or len(cutter.rows) < held:  # a front was cut off
                self.held.put([(cutter.rows.tobytes(),)])
            elif ready:
                self.held.appendValue((cutter.rows[held:].tobytes(),))
            self.stands.update((cutter.first, cutter.opening, cutter.resumed, cutter.tiles, pickle.dumps(cutter.spare), following, last))
        if out:
            yield pd.DataFrame([(key[0], *t) for t in out], columns=[c.split()[0] for c in TILES.split(", ")]).astype({"above": "Int32", "below": "Int32"})

    def close(self) -> None:
        pass


def tiles_of_stream(features: DataFrame, panel: Panel) -> DataFrame:
    """`TILES` of a stream of `FEATURES` and `ended`, true in a book's last row; the same as operators.strips.strip_tiles() gives.

    Rows may come in any order and again: they wait for those before them. Row numbers begin at 0 and have no gaps. Of a book that has ended only that is kept, lest rows that come again begin it anew. Null books are left out.
    The session keeps its state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    own = features.select(*[c.split()[0] for c in FEATURES.split(", ")], F.coalesce("ended", F.lit(False)).alias("ended")).where("book is not null")
    return own.groupBy("book").transformWithStateInPandas(_Books(panel), TILES, "append", "none")
