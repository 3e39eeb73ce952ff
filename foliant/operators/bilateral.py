"""Means over what lies near and is alike: a bilateral grid, splatted, blurred and read by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _around(at: Column, size: Column | None, kernel: tuple[float, ...]) -> Column:
    """array<struct<at,w>>: the places that a value at `at` is blurred to, by a symmetric odd kernel. With a size, what would be asked for outside is asked at the edge."""
    half = len(kernel) // 2
    if size is None:
        return F.array(*[F.struct((at + k).alias("at"), F.lit(float(kernel[k + half])).alias("w")) for k in range(-half, half + 1)])
    asked = lambda to, k: F.least(F.greatest(to + k, F.lit(0)), size - 1)  # noqa: E731  where a place looks for its k-th neighbour
    weight = lambda to: sum((F.when(asked(to, k) == at, float(kernel[k + half])).otherwise(0.0) for k in range(-half, half + 1)), F.lit(0.0))
    to = F.filter(F.array(*[at + k for k in range(-half, half + 1)]), lambda t: (t >= 0) & (t < size))
    return F.transform(to, lambda t: F.struct(t.alias("at"), weight(t).alias("w")))


def bilateral_grid(squares: DataFrame, page: str, zoom: int, step: float, near: tuple[float, ...], across: tuple[float, ...]) -> DataFrame:
    """(page, cy, cx, level, weight, total): the blurred grid of `squares` (page, y, x, share, value). A cell is `zoom` squares wide and high, a level `step` of the value.

    A square gives its share to the two levels about its value. Levels are blurred by `near`, rows and columns of cells by `across`, of which the outermost repeat.
    One aggregate by cell and level, and one over what these are blurred to: both have a row for a cell and level, however many squares there are.
    """
    level = F.col("value") / step
    low = F.floor(level)
    part = level - low
    both = F.array(F.struct(low.alias("level"), (F.col("share") * (1 - part)).alias("w")), F.struct((low + 1).alias("level"), (F.col("share") * part).alias("w")))
    cell = lambda c: F.floor(F.col(c) / zoom).alias(f"c{c}")
    own = squares.where("share > 0").select(F.struct(F.col(page)).alias("_page"), cell("y"), cell("x"), "value", F.explode(both).alias("s"))
    splat = own.groupBy("_page", "cy", "cx", F.col("s.level").alias("level")).agg(F.sum("s.w").alias("weight"), F.sum(F.col("s.w") * F.col("value")).alias("total"))
    sizes = squares.groupBy(F.struct(F.col(page)).alias("_page")).agg((F.floor(F.max("y") / zoom) + 1).alias("_rows"), (F.floor(F.max("x") / zoom) + 1).alias("_cols"))
    sized = splat.join(sizes, "_page")
    spread = sized.select("_page", "cy", "cx", "_rows", "_cols", "weight", "total", F.explode(_around(F.col("level"), None, near)).alias("l"))
    spread = spread.withColumn("r", F.explode(_around(F.col("cy"), F.col("_rows"), across))).withColumn("c", F.explode(_around(F.col("cx"), F.col("_cols"), across)))
    w = F.col("l.w") * F.col("r.w") * F.col("c.w")
    return spread.groupBy("_page", F.col("r.at").alias("cy"), F.col("c.at").alias("cx"), F.col("l.at").alias("level")).agg(F.sum(w * F.col("weight")).alias("weight"), F.sum(w * F.col("total")).alias("total"))


def bilateral_means(squares: DataFrame, page: str, zoom: int, step: float, near: tuple[float, ...], across: tuple[float, ...]) -> DataFrame:
    """(page, y, x, mean): each square's mean over the grid about it, read between the four cells and the two levels that it lies among. Squares without a share have no row.

    Null pages are one page; a page's squares begin at 0. Each square asks for eight places of the grid, which come by a join on them.
    """
    grid = bilateral_grid(squares, page, zoom, step, near, across)
    level = F.col("value") / step
    low = F.floor(level)

    def corners(c: str, name: str) -> Column:
        moved = F.col(c) + zoom // 2
        part = (moved % zoom + 0.5) / zoom
        first = F.floor(moved / zoom) - 1
        return F.explode(F.array(F.struct(first.alias("at"), (1 - part).alias("w")), F.struct((first + 1).alias("at"), part.alias("w")))).alias(name)

    asked = squares.where("share > 0").select(F.struct(F.col(page)).alias("_page"), "y", "x", level.alias("_level"), low.alias("_low"), corners("y", "r"))
    asked = asked.select("*", corners("x", "c")).select("*", F.explode(F.array(F.struct(F.col("_low").alias("at"), (1 - (F.col("_level") - F.col("_low"))).alias("w")), F.struct((F.col("_low") + 1).alias("at"), (F.col("_level") - F.col("_low")).alias("w")))).alias("l"))
    places = asked.select("_page", "y", "x", F.col("r.at").alias("cy"), F.col("c.at").alias("cx"), F.col("l.at").alias("level"), (F.col("r.w") * F.col("c.w") * F.col("l.w")).alias("_w"))
    read = places.join(grid, ["_page", "cy", "cx", "level"]).groupBy("_page", "y", "x").agg((F.sum(F.col("_w") * F.col("total")) / F.sum(F.col("_w") * F.col("weight"))).alias("mean"))
    return read.select(F.col(f"_page.{page}").alias(page), "y", "x", "mean")


def held_change(new: Column, old: Column, most: float) -> Column:
    """`old` moved towards `new`, by `most` at most."""
    return old + F.greatest(F.lit(-most), F.least(F.lit(most), new - old))
