"""Row masks as runs: (keys, start, stop) with `stop` behind the last row, disjoint and not touching. AND, OR, NOT and look-ups go from runs to runs, never by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.windows import as_of


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of pieces that may touch, or be the same, but don't overlap otherwise."""
    w = Window.partitionBy(*keys).orderBy("start")
    marked = pieces.withColumn("_run", F.sum((F.lag("stop").over(w).isNull() | (F.lag("stop").over(w) < F.col("start"))).cast("int")).over(w))
    return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def mask_runs(rows: DataFrame, keys: list[str], row: str, flag: Column, least: int = 1) -> DataFrame:
    """Runs of rows, numbered by `row`, for which `flag` holds; a missing row ends a run, a null flag doesn't hold. Runs shorter than `least` are left out."""
    on = rows.where(flag).select(*keys, F.col(row).cast("long").alias("start"), (F.col(row).cast("long") + 1).alias("stop"))
    return at_least(_joined(on, keys), least)


def at_least(runs: DataFrame, least: int) -> DataFrame:
    return runs.where(F.col("stop") - F.col("start") >= least)


def algebra(runs: DataFrame, keys: list[str], side: str, sides: list[str], held: dict[str, Column]) -> DataFrame:
    """(keys, how, start, stop): what several masks have together, all in one sweep over their ends; null keys are a key like any other.

    `runs` (keys, side, start, stop): the runs of the masks `sides`. `held`: for each `how` where it holds, by boolean columns named as the masks. Nothing but the first shuffle by `keys` is needed,
    and none if the runs were dealt by them.
    """
    ends = runs.select(*keys, side, F.inline(F.array(F.struct(F.col("start").alias("start"), F.lit(1).alias("_d")), F.struct(F.col("stop").alias("start"), F.lit(-1).alias("_d")))))
    points = ends.groupBy(*keys, "start").agg(*[F.sum(F.when(F.col(side) == s, F.col("_d")).otherwise(0)).alias(f"_d{i}") for i, s in enumerate(sides)])
    w = Window.partitionBy(*keys).orderBy("start")
    swept = points.select(*keys, "start", F.lead("start").over(w).alias("stop"), *[(F.sum(f"_d{i}").over(w) > 0).alias(s) for i, s in enumerate(sides)])
    hows = F.array_compact(F.array(*[F.when(on, F.lit(how)) for how, on in held.items()]))
    return _joined(swept.where(F.col("stop").isNotNull()).select(*keys, F.explode(hows).alias("how"), "start", "stop"), [*keys, "how"])


def combine(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """`how`: and, or, minus (left and not right)."""
    held = {"and": F.col("_l") & F.col("_r"), "or": F.col("_l") | F.col("_r"), "minus": F.col("_l") & ~F.col("_r")}[how]
    sided = [runs.select(*keys, F.lit(s).alias("_side"), "start", "stop") for s, runs in (("_l", left), ("_r", right))]
    return algebra(sided[0].unionByName(sided[1]), keys, "_side", ["_l", "_r"], {how: held}).drop("how")


def complement(runs: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """NOT within `extents` (keys, start, stop)."""
    return combine(extents, runs, keys, "minus")


def run_at(runs: DataFrame, places: DataFrame, keys: list[str], place: str) -> DataFrame:
    """`places` with `start` and `stop` of the run that holds each, nulls where none does. One union and one window, no range join."""
    starts = runs.select(*keys, F.col("start").alias(place), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    held = F.col(place) < F.col("_stop")
    found = as_of(places, starts, keys, place, ["_start", "_stop"])
    return found.select(*places.columns, F.when(held, F.col("_start")).alias("start"), F.when(held, F.col("_stop")).alias("stop"))
