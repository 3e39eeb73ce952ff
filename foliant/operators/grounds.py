"""Grounds of pages: the shade of a border, and which of some colours what is padded takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# How far a colour may lie from one that it matches; the least share of a border that is flat, and that a colour covers.
MATCH, SHARE = 12, 0.30
BANDS = ("r", "g", "b")
#: Lines and candidates that one task joins and counts, about: larger tables take more tasks, up to as many as Spark writes a file for each without holding what a task has read.
TASK_ROWS, TASKS = 1 << 16, 200


def border_ground(pixels: DataFrame, page: str) -> DataFrame:
    """(page, r, g, b): the median of each band over a page's border `pixels` (page, r, g, b), halves rounded to even."""
    return pixels.groupBy(page).agg(*[F.bround(F.percentile(c, F.lit(0.5)), 0).cast("int").alias(c) for c in BANDS])


def _near(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b)]) <= MATCH


def _by_page(rows: DataFrame, page: str, tasks: int) -> DataFrame:
    """`rows` dealt by page to so many tasks; _key and _none stand for the page, null being one of them."""
    own = F.col(page)
    key = F.coalesce(own, F.lit(0).cast(rows.schema[page].dataType)) if isinstance(rows.schema[page].dataType, NumericType) else F.coalesce(own.cast("string"), F.lit(""))
    return rows.withColumns({"_key": key, "_none": own.isNull()}).repartition(tasks, "_key", "_none")


def covering_colour(border: DataFrame, candidates: DataFrame, page: str) -> DataFrame:
    """(page, r, g, b): the colour that a page's padding takes instead of its present one; pages without a row keep that.

    `border`: its lines (page, flat, ends, r, g, b); `candidates` (page, no, r, g, b), a few a page, no 0 being the present colour. A candidate covers the flat lines that match it. Ordered
    rejection: nothing, if less than a third of the border is flat, if all of that matches the present colour or all candidates do; then the candidate that covers most (of equal ones the
    first) must not be the present one, cover a third, and cover no less than the present one of the lines at the ends, nor of the others. The colour is the mean of the lines
    covered; next to black or white it is those, and nothing if the present one is that.
    """
    least = int(border.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer Spark would deal the rows anew
    tasks = max(least, min(TASKS, -(-(border.count() + candidates.count()) // TASK_ROWS)))
    keys = ["_key", "_none"]
    now = _by_page(candidates.where("no = 0").select(page, *[F.col(c).alias(f"now_{c}") for c in BANDS]), page, tasks).drop(page)
    named = _by_page(candidates.select(page, "no", *[F.col(c).alias(f"c_{c}") for c in BANDS]), page, tasks).hint("merge").join(now, keys).drop(page)
    both = _by_page(border.select(page, "flat", "ends", *BANDS), page, tasks).hint("merge").join(named, keys)
    of = lambda prefix: tuple(F.col(f"{prefix}{c}") for c in BANDS)
    covered = F.col("flat") & _near(of(""), of("c_"))
    share = lambda part: F.avg(F.when(part, covered.cast("double")))  # noqa: E731  null where there are no such lines
    counted = both.groupBy(*keys, page, "no", *[f"now_{c}" for c in BANDS]).agg(
        F.avg(F.col("flat").cast("double")).alias("flats"), F.max(F.col("flat") & ~_near(of(""), of("now_"))).alias("other"), F.max(~_near(of("c_"), of("now_"))).alias("apart"),
        F.avg(covered.cast("double")).alias("share"), share(F.col("ends")).alias("at_ends"), share(~F.col("ends")).alias("elsewhere"), *[F.avg(F.when(covered, F.col(c))).alias(c) for c in BANDS],
    )
    best = F.max_by(F.struct("no", "share", "at_ends", "elsewhere", *BANDS), F.struct("share", -F.col("no")))
    present = lambda c: F.max(F.when(F.col("no") == 0, F.col(c))).alias(f"_{c}")
    told = counted.groupBy(*keys, page, *[f"now_{c}" for c in BANDS]).agg(best.alias("best"), F.max("flats").alias("flats"), F.max("other").alias("other"), F.max("apart").alias("apart"), present("at_ends"), present("elsewhere"))
    no_less = lambda c: F.coalesce(F.col(f"best.{c}") >= F.col(f"_{c}"), F.lit(True))
    kept = told.where((F.col("flats") >= SHARE) & F.col("other") & F.col("apart") & (F.col("best.no") != 0) & (F.col("best.share") >= SHARE) & no_less("at_ends") & no_less("elsewhere"))
    found = tuple(F.col(f"best.{c}") for c in BANDS)
    is_pure = lambda v: _near(found, (F.lit(v),) * 3)
    pure = F.when(is_pure(0.0), 0.0).when(is_pure(255.0), 255.0)
    is_now = F.coalesce(F.greatest(*[F.abs(F.col(f"now_{c}") - pure) for c in BANDS]) == 0, F.lit(False))
    return kept.where(~is_now).select(page, *[F.coalesce(pure, F.col(f"best.{c}")).alias(c) for c in BANDS])
