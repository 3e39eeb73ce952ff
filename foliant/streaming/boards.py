"""Boards of what is going on and caches of what was found: a bounded state for each, in batch over rows in order and over a stream."""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.functions.names import job_id

# Jobs of a board and how long one stays; answers of a cache and how long one that found something, or nothing, is fresh. In seconds.
JOBS, JOB_S = 64, 900
ANSWERS, FOUND_S, MISSED_S = 512, 900, 300

UPDATES = "board string, ts timestamp, job string, stage string, done long, total long"
STANDS = "board string, ts timestamp, job string, stage string, done long, total long, jobs int"
ASKED = "cache string, ts timestamp, key string, found boolean"
ANSWERED = "cache string, ts timestamp, key string, hit boolean, found boolean, held int"


@dataclass
class Board:
    """Jobs by their last update, the oldest first. Each update drops jobs that have had none for longer than a while, and the oldest beyond a number."""

    jobs: OrderedDict = field(default_factory=OrderedDict)
    most: int = JOBS
    stay: float = JOB_S

    def step(self, ts: pd.Timestamp, job: str, stage: str | None, done: int | None, total: int | None) -> tuple:
        """How the job stands after an update: what it doesn't say stays as it was, or as a job begins."""
        before = self.jobs.pop(job, ("starting", 0, 0, None))[:3]
        now = tuple(old if pd.isna(new) else new for old, new in zip(before, (stage, done, total)))
        self.jobs[job] = (*now, ts)
        while self.jobs and (ts - next(iter(self.jobs.values()))[3]).total_seconds() > self.stay:
            self.jobs.popitem(last=False)
        while len(self.jobs) > self.most:
            self.jobs.popitem(last=False)
        return (ts, job, *now, len(self.jobs))


@dataclass
class Answers:
    """Answers and until when they are fresh. Once there are more than a number of them, the next to be kept clears the rest."""

    until: dict = field(default_factory=dict)
    most: int = ANSWERS

    def step(self, ts: pd.Timestamp, key: str, found: bool | None) -> tuple:
        """(ts, key, hit, found, held): whether a question is answered from here; if not, `found` is what asking gives, and it is kept. Null finds nothing."""
        kept = self.until.get(key)
        hit = kept is not None and ts < kept[0]
        if not hit:
            if len(self.until) > self.most:
                self.until.clear()
            kept = ts + pd.Timedelta(seconds=FOUND_S if found is True or found == True else MISSED_S), bool(found) and not pd.isna(found)  # noqa: E712  numpy's booleans
            self.until[key] = kept
        return (ts, key, hit, kept[1], len(self.until))


def _in_order(rows: DataFrame, schema: str, out: str, begin: Callable) -> DataFrame:
    """Each key's rows (the first column's) through a state of its own, in the order of the others: a sorted stream a task, of which it holds one state."""
    names = [c.split()[0] for c in schema.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            told = []
            for own, *row in b.itertuples(index=False, name=None):
                if state is None or own != key:
                    key, state = own, begin()
                told.append((own, *state.step(*row)))
            if told:
                yield pd.DataFrame(told, columns=[c.split()[0] for c in out.split(", ")])

    return rows.select(names).where(F.col(names[0]).isNotNull() & F.col("ts").isNotNull()).repartition(names[0]).sortWithinPartitions(*names).mapInPandas(fold, out)


def board_stands(updates: DataFrame, most: int = JOBS, stay: float = JOB_S) -> DataFrame:
    """`STANDS` of `UPDATES`: after each update, how its job stands and how many jobs the board has. Updates count by time, those of one time by their other columns.

    Rows without a board, a time or a legal job id (functions.names.job_id) are left out.
    """
    return _in_order(updates.where(job_id(F.col("job")).isNotNull()), UPDATES, STANDS, lambda: Board(most=most, stay=stay))


def cached_answers(asked: DataFrame, most: int = ANSWERS) -> DataFrame:
    """`ANSWERED` of `ASKED` (`found`: what would be found if one had to look): which questions a cache answers, and with what."""
    return _in_order(asked, ASKED, ANSWERED, lambda: Answers(most=most))


class _Boards(StatefulProcessor):
    """A board's jobs as one value, of at most so many jobs."""

    def __init__(self, most: int, stay: float) -> None:
        self.most, self.stay = most, stay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("jobs", "jobs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        board = Board(pickle.loads(self.held.get()[0]) if self.held.exists() else OrderedDict(), self.most, self.stay)
        names = [c.split()[0] for c in UPDATES.split(", ")]
        all_rows = pd.concat(list(rows))[names].sort_values(names[1:], na_position="first")
        out = [(key[0], *board.step(*row[1:])) for row in all_rows.itertuples(index=False, name=None)]
        self.held.update((pickle.dumps(board.jobs),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STANDS.split(", ")])

    def close(self) -> None:
        pass


def boards_of_stream(updates: DataFrame, most: int = JOBS, stay: float = JOB_S) -> DataFrame:
    """board_stands() of a stream; a batch's updates are taken in their order, batches as they come. State in RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    own = updates.select([c.split()[0] for c in UPDATES.split(", ")]).where(F.col("board").isNotNull() & F.col("ts").isNotNull() & job_id(F.col("job")).isNotNull())
    return own.groupBy("board").transformWithStateInPandas(_Boards(most, stay), STANDS, "append", "none")
