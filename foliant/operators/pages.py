"""Operators over the rows, boxes and sizes of page images."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.windows import null_safe_join

# Bytes of a part and of a megapixel by format; rows of one shade, white and black; marks of pure colours.
PART_BYTES, MEGAPIXEL_BYTES = 3_500_000_000, {"pngc": 200_000, "webpc": 60_000}
QUIET, WHITE, BLACK, PURE = 15, 235, 30, 12
LUMA = (0.299, 0.587, 0.114)
INK_SHARE = 3e-5
SURE, SURE_LINE = 0.95, 0.90


@lru_cache(maxsize=1)
def bayer(n: int = 8) -> tuple[float, ...]:
    """The thresholds of an n x n ordered dither, by rows: each step lays four copies of the matrix before it, four times as high, one apart."""
    m = [[0]]
    while len(m) < n:
        m = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in m] + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in m]
    return tuple((v + 0.5) / (n * n) for row in m for v in row)


def dither_threshold(row: Column, column: Column, n: int = 8) -> Column:
    return F.get(F.array(*map(F.lit, bayer(n))), (row % n * n + column % n).cast("int"))


def dithered_levels(v: Column, row: Column, column: Column) -> Column:
    """Sixteen levels of 0..255, the rounding moved by the pixel's threshold."""
    moved = F.rint((v + (dither_threshold(row, column) - 0.5) * 17) / 17)
    return F.greatest(F.lit(0.0), F.least(F.lit(15.0), moved)).cast("int")


def strip_parts(pages: DataFrame, book: str, count: Column, width: int, largest_scale: float = 1.5, fmt: str = "pngc") -> DataFrame:
    """(book, parts) of a strip: `pages` are sampled sizes (book, page, w, h; nulls where unknown), `count` an aggregate of how many pages there are.

    The commonest width, of equal ones the first seen, scaled and at most that of the panel, gives the rows; without sizes a page counts as two panel widths.
    """
    widths = pages.where("w is not null").groupBy(book, "w").agg(F.count("*").alias("n"), F.min("page").alias("seen")).groupBy(book).agg(F.min_by("w", F.struct(-F.col("n"), F.col("seen"))).alias("modal"))
    sums = pages.groupBy(book).agg(count.alias("count"), F.avg(F.col("h") / F.col("w")).alias("ratio"))
    wide = F.least(F.lit(float(width)), F.rint(F.col("modal") * largest_scale))
    rows = F.col("count") * F.coalesce(F.col("ratio") * wide, F.lit(2.0 * width))
    size = rows * width / 1e6 * MEGAPIXEL_BYTES.get(fmt, MEGAPIXEL_BYTES["pngc"])
    return null_safe_join(sums, widths, [book], "left").select(book, F.when(F.col("count") <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(size / PART_BYTES))).cast("long").alias("parts"))


def between_lines(gaps: DataFrame, boxes: DataFrame, key: str, reach: int) -> DataFrame:
    """The `gaps` (key, start, stop) that part two lines of lettering: of the `boxes` (key, top, bottom, left, right) some end shortly above, some begin shortly below, and their extents overlap.

    One join by key and one aggregate a gap; boxes are those of one page.
    """
    near = gaps.join(boxes, key)
    above = (F.col("top") < F.col("start")) & F.col("bottom").between(F.col("start") - reach, F.col("stop"))
    below = (F.col("bottom") > F.col("stop")) & F.col("top").between(F.col("start"), F.col("stop") + reach)
    of = lambda f, side, c: f(F.when(side, F.col(c)))
    ends = near.groupBy(*gaps.columns).agg(F.greatest(of(F.min, above, "left"), of(F.min, below, "left")).alias("_l"), F.least(of(F.max, above, "right"), of(F.max, below, "right")).alias("_r"), F.count_if(above).alias("_a"), F.count_if(below).alias("_b"))
    return ends.where("_a > 0 and _b > 0 and _r > _l").select(gaps.columns)


def read_marks(marks: DataFrame, reads: DataFrame, page: str, lines: bool = False) -> DataFrame:
    """(page, mark, text): page numbers. Of the `reads` (page, text, score, x0, y0, x1, y1) those that name a number, cover half a mark's area, and have its centre within the mark and a quarter about it.

    `marks`: (page, mark, mx0, my0, mx1, my1), the few candidates of a page; one without an area has no number. `lines`: the reads are what the marks were read as
    lines, too, so that those are trusted which read_lines() finds.
    """
    sure = (F.col("score") >= SURE) & (folio_number(F.col("text")) != "0")
    both = marks.join(reads.where(sure | _sure_line(F.col("text"), F.col("score")) if lines else sure), page)
    over = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(F.col(b), F.col(hi)) - F.greatest(F.col(a), F.col(lo)))
    shared = over("x0", "x1", "mx0", "mx1") * over("y0", "y1", "my0", "my1")
    area = (F.col("mx1") - F.col("mx0")) * (F.col("my1") - F.col("my0"))
    within = lambda a, b, lo, hi: ((F.col(a) + F.col(b)) / 2).between(F.col(lo) - (F.col(hi) - F.col(lo)) / 4, F.col(hi) + (F.col(hi) - F.col(lo)) / 4)
    return both.where((area > 0) & (shared >= area / 2) & within("x0", "x1", "mx0", "mx1") & within("y0", "y1", "my0", "my1")).select(page, "mark", "text")


def read_lines(lines: DataFrame) -> DataFrame:
    """`lines` (text, score: a mark read as one line) with `found`: true, it is a page number of two digits or more; false, it holds no digit; null, the mark's surroundings have to be read."""
    return lines.withColumn("found", F.when(_sure_line(F.col("text"), F.col("score")), True).when(~F.coalesce(F.col("text"), F.lit("")).rlike("[0-9]"), False))


def _sure_line(text: Column, score: Column) -> Column:
    return (F.length(folio_number(text)) >= 2) & (score >= SURE_LINE)


def folio_number(text: Column) -> Column:
    """The one to four digits of a text that has nothing else but dashes, dots, white space, opening brackets before them and closing ones after; null of others."""
    digits = F.regexp_extract(F.trim(text), r"^[-–—.\s\[(]*([0-9]{1,4})[-–—.\s\])]*$", 1)
    return F.when(digits != "", digits)


def row_classes(lo: Column, hi: Column) -> Column:
    """struct<quiet, white, black, gutter> of a row by its least and greatest shade."""
    quiet = hi - lo <= QUIET
    white, black = quiet & (lo >= WHITE), quiet & (hi <= BLACK)
    return F.struct(quiet.alias("quiet"), white.alias("white"), black.alias("black"), (white | black).alias("gutter"))


def busyness(luma: Column) -> Column:
    """How busy a row is: the share of steps over three pixels of 128 or more, and a ten-thousandth of the mean step from pixel to pixel."""

    def steps(over: int) -> Column:
        n = F.greatest(F.lit(0), F.size(luma) - over)
        return F.zip_with(F.slice(luma, F.lit(over + 1), n), F.slice(luma, F.lit(1), n), lambda a, b: F.abs(a - b))

    mean = lambda s, of: F.aggregate(s, F.lit(0.0), lambda acc, v: acc + of(v)) / F.greatest(F.lit(1), F.size(s))
    return mean(steps(3), lambda v: F.when(v >= 128, 1.0).otherwise(0.0)) + mean(steps(1), lambda v: v) * 1e-4


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * LUMA[0] + green * LUMA[1] + blue * LUMA[2]


def pure(v: Column) -> Column:
    """Shades next to black or white become those."""
    return F.when(v <= PURE, 0).when(v >= 255 - PURE, 255).otherwise(v)


def smooth_length(n: Column, most: tuple[int, ...] = (62, 39, 27, 22)) -> Column:
    """The least length of at least n whose only prime factors are 2, 3, 5 and 7, each at most so many times as `most` says; null if there is none below 2^63."""
    lengths = [1]
    for p, times in zip((2, 3, 5, 7), most):
        lengths = [x * p**k for x in lengths for k in range(times + 1) if x * p**k < 1 << 63]
    known = np.array(sorted(lengths), np.int64)

    @F.arrow_udf("long")
    def least(wanted: pa.Array) -> pa.Array:
        at = np.searchsorted(known, pc.fill_null(wanted, 0).to_numpy(zero_copy_only=False))
        none = (at == len(known)) | pc.is_null(wanted).to_numpy(zero_copy_only=False)
        return pa.array(known[np.minimum(at, len(known) - 1)], mask=none)

    return least(n.cast("long"))


def open_window(width: Column, height: Column) -> Column:
    """The odd width of the window that specks are told by: a 133rd of the shorter side, from 3 to 21."""
    return F.greatest(F.lit(3), F.least(F.lit(21), F.bround(F.least(width, height) / 133.0).cast("int").bitwiseOR(F.lit(1))))


def empty_tiles(rows: DataFrame, keys: list[str], ink: Column, area: float) -> DataFrame:
    """(keys, ink, empty): tiles with next to no ink; where all of a book's (the first key's) are empty, the first stays."""
    tiles = rows.groupBy(*keys).agg(F.sum(ink).alias("ink")).withColumn("empty", F.col("ink") <= INK_SHARE * area)
    book = tiles.groupBy(keys[0]).agg(F.min("empty").alias("_all"), F.min(keys[1]).alias("_first"))
    return null_safe_join(tiles, book, [keys[0]]).withColumn("empty", F.col("empty") & ~(F.col("_all") & (F.col(keys[1]) == F.col("_first")))).drop("_all", "_first")


def trim_cache(entries: DataFrame, cache: str, cap: Column, totals) -> DataFrame:
    """The entries that stay of `entries` (cache, mtime, size, path): the oldest go, of equal times the smallest, while what is left exceeds 90 % of a cap that is itself exceeded.

    `totals(df, keys, order, column)`: running sums before each row; see operators.windows.running_before().
    """
    summed = null_safe_join(totals(entries, [cache], ["mtime", "size", "path"], "size"), entries.groupBy(cache).agg(F.sum("size").alias("_total"), cap.alias("_cap")), [cache])
    return summed.where((F.col("_total") <= F.col("_cap")) | (F.col("_total") - F.col("before") <= F.floor(F.col("_cap") * 0.9))).select(entries.columns)
