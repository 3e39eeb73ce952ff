"""Archives repacked: entries in natural order, numbered, cut into parts, with a cover and a record of what they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.strings import is_image, is_junk, natural_key
from foliant.operators.windows import exclusive_sum
from foliant.sources.archives import named

#: The name of the record that says what a book is.
RECORD = "ComicInfo.xml"


def archive_totals(entries: DataFrame) -> DataFrame:
    """(archive, entries, images, junk, declared): what an archive says it holds. Junk counts for nothing but itself."""
    kept = ~is_junk(F.col("name"))
    return entries.groupBy("archive").agg(
        F.count_if(kept).alias("entries"), F.count_if(kept & is_image(F.col("name"))).alias("images"), F.count_if(~kept).alias("junk"), F.coalesce(F.sum(F.when(kept, F.col("file_size"))), F.lit(0)).alias("declared")
    )


def in_parts(pages: DataFrame, book: str, order: list[str], size: str, edge: Column, parts: int) -> DataFrame:
    """`pages` with `part`, from 1: parts of about equal bytes. A bound moves to the nearest `edge` (a condition on a page and the one before it: a folder begins) if that is within half
    a part of bytes; of two as near the first.
    """
    w, every = Window.partitionBy(book).orderBy(*order), Window.partitionBy(book)
    p = pages.withColumns({"_i": F.row_number().over(w) - 1, "_before": exclusive_sum(size, [book], order), "_total": F.sum(size).over(every), "_n": F.count("*").over(every), "_edge": edge})
    if parts < 2:
        return pages.withColumn("part", F.lit(1).cast("long"))
    off = lambda k: F.abs(parts * F.col("_before") - k * F.col("_total"))
    end = lambda k: F.coalesce(F.min(F.when(parts * F.col("_before") >= k * F.col("_total"), F.col("_i"))), F.max("_n"))
    near = lambda k: F.min(F.when(F.col("_edge"), F.struct(off(k).alias("off"), F.col("_i").alias("at"))))
    bounds = p.groupBy(book).agg(F.max("_total").alias("_total"), *[f(k).alias(f"_{n}{k}") for k in range(1, parts) for n, f in (("end", end), ("near", near))])
    cuts = bounds.select(F.col(book).alias("_book"), F.array(*[F.when(2 * F.col(f"_near{k}.off") <= F.col("_total"), F.col(f"_near{k}.at")).otherwise(F.col(f"_end{k}")) for k in range(1, parts)]).alias("_cuts"))
    joined = p.join(cuts, F.col(book).eqNullSafe(F.col("_book")))
    return joined.withColumn("part", (F.lit(1) + F.size(F.filter("_cuts", lambda c: F.col("_i") >= c))).cast("long")).select(*pages.columns, "part")


def repack(entries: DataFrame, parts: int = 1, covers: DataFrame | None = None, records: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """(file, place, name, content) for sources.zip_sink.write_archives(): each archive of `entries` (sources.archives.ENTRIES) as `parts` files.

    Junk goes; images are numbered in natural order over the whole archive and take the suffix that their bytes ask for; of the others each part has a copy, in their natural place.
    `covers` (archive, content) come first, as page 0; null ones are left out. `records` (archive, content) go last, to archives that have no record of their own.
    Images are dealt over parts by their bytes, at folders' edges where those are near. Names that repeat stay, in the order of the archive.
    """
    kept = entries.where(~is_junk(F.col("name"))).withColumn("_image", is_image(F.col("name"))).withColumn("_key", natural_key(F.col("name")))
    w = Window.partitionBy("archive")
    order = [F.col("_key"), F.col("ordinal")]
    placed = kept.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("page", F.when(F.col("_image"), F.sum(F.col("_image").cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))
    images = placed.where("_image")
    folder = F.regexp_extract("name", "^(.*)/[^/]*$", 1)
    images = images.withColumn("_folder", folder)
    images = in_parts(images, "archive", ["place"], "file_size", F.col("_folder") != F.lag("_folder").over(Window.partitionBy("archive").orderBy("place")), parts)
    copies = placed.where("not _image").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(parts).cast("long"))))
    columns = ["archive", "part", "place", "page", "name", "content"]
    pieces = [images.select(columns), copies.select(columns)]
    if covers is not None:
        pieces.append(covers.where("content is not null").select("archive", F.lit(1).cast("long").alias("part"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("page"), F.lit("cover.png").alias("name"), "content"))
    if records is not None:
        own = kept.where(F.lower("name").endswith(RECORD.lower())).select(F.col("archive").alias("_own")).distinct()
        added = records.join(own, F.col("archive").eqNullSafe(F.col("_own")), "left_anti").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(parts).cast("long"))))
        pieces.append(added.select("archive", "part", F.lit((1 << 62)).alias("place"), F.lit(None).cast("long").alias("page"), F.lit(RECORD).alias("name"), "content"))
    every = named(reduce(DataFrame.unionByName, pieces).withColumn("kind", F.when(F.col("page").isNotNull(), "page").otherwise("copy")), digits)
    stem = F.regexp_replace(F.regexp_extract("archive", "([^/]*)$", 1), r"\.[^.]*$", "")
    file = F.concat(stem, F.when(F.lit(parts) > 1, F.format_string(f" (%d of {parts})", "part")).otherwise(""), F.lit(".cbz"))
    return every.select(file.alias("file"), "place", "name", "content")
