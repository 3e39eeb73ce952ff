"""Streams of download updates: sessions that go stale, updates that end, one request at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds without an update after which a download is lost.
STALE_S = 900
ENDS = ("done", "failed")


def stale_downloads(updates: DataFrame, stale_s: int = STALE_S, late: str = "10 minutes") -> DataFrame:
    """(id, state, steps, touched) of downloads that ended or were lost, from a stream of (id, stage, ts timestamp).

    The first update with a stage of ENDS ends a download; updates after it change nothing. One without updates for
    `stale_s` seconds of event time is lost. Null ids are one download; null stages are updates.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            steps, touched, ended = state.get
            state.remove()
            if not ended:
                yield pd.DataFrame({"id": [key[0]], "state": ["lost"], "steps": [steps], "touched": [pd.Timestamp(touched, unit="us")]})
            return
        steps, touched, ended = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for stage, ts in zip(rows["stage"], rows["ts"]):
            if ended:
                break
            steps, touched = steps + 1, max(touched, int(ts.value // 1000))
            ended = stage in ENDS
            if ended:
                yield pd.DataFrame({"id": [key[0]], "state": [stage], "steps": [steps], "touched": [pd.Timestamp(touched, unit="us")]})
        state.update((steps, touched, ended))
        state.setTimeoutTimestamp(max(touched // 1000 + stale_s * 1000, state.getCurrentWatermarkMs() + 1))

    own = updates.select("id", "stage", "ts").withWatermark("ts", late)
    return own.groupBy("id").applyInPandasWithState(step, "id string, state string, steps long, touched timestamp", "steps long, touched long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(updates: DataFrame, stale_s: int = STALE_S, late: str = "10 minutes") -> DataFrame:
    """(id, start, last, steps): runs of updates without a gap of `stale_s`; Spark's own session windows."""
    windowed = updates.withWatermark("ts", late).groupBy("id", F.session_window("ts", f"{stale_s} seconds").alias("w")).agg(F.count("*").alias("steps"), F.max("ts").alias("last"))
    return windowed.select("id", F.col("w.start").alias("start"), "last", "steps")


def one_at_a_time(requests: DataFrame, keys: list[str], late: str = "15 minutes") -> DataFrame:
    """The first request of each key; repeats within the watermark are dropped."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def newest_of_batch(write: Callable[[DataFrame], None], key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of each key only the newest row of a micro-batch goes to `write`."""

    def each(batch: DataFrame, batch_id: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        write(batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))

    return each
