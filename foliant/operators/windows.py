"""Operators over ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key in `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def exclusive_sum(value: str, keys: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def islands(df: DataFrame, flag: Column, keys: list[str], order: list[str], least: int) -> DataFrame:
    """(keys, first, last, n): maximal runs of rows for which `flag` holds, of at least `least` rows; order[0] bounds them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_island", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w))
    return run.where("_on").groupBy(*keys, "_island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """`left` with the values of the latest row of `right` at or before its time, of the same keys; nulls where there is none.

    One union and one window instead of a range join; right rows come first among equal times.
    """
    tagged = right.select(*keys, time, F.struct(*values).alias("_r"), F.lit(None).alias("_l"), F.lit(0).alias("_side")).unionByName(
        left.select(*keys, time, F.lit(None).alias("_r"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side")))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null is one; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]), how).drop(*[f"_other_{k}" for k in keys])


def running_before(df: DataFrame, keys: list[str], order: list[str], column: str, name: str = "before", buckets: int = 64) -> DataFrame:
    """`df` with the sum of `column` over the rows before it of its keys, in `order` (unique within the keys), without one task for a key.

    Each key's first order column is cut into ranges at quantiles of all rows; sums within a range are a window of (key, range), and the sums of ranges, of
    which a key has at most `buckets`, are added by a window over those alone. Rows that share a value of the first order column stay in one range.
    """
    cuts = df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [i / buckets for i in range(1, buckets)]).alias("_cuts"))  # one row
    ranged = df.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order[0]).cast("double")))).drop("_cuts")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(column).alias("_sum"))
    base = sums.select(*keys, "_range", exclusive_sum("_sum", keys, ["_range"]).alias("_base"))
    inside = ranged.withColumn("_inside", exclusive_sum(column, [*keys, "_range"], order))
    return null_safe_join(inside, base, [*keys, "_range"]).withColumn(name, F.col("_inside") + F.col("_base")).drop("_range", "_inside", "_base")
