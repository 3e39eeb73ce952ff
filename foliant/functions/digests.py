"""Digests of samples of files that come in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a sample, and where they are.
SAMPLE, PLACES = 1024, (0, *(1024 << 2 * i for i in range(11)))


def sampled_md5(chunks: DataFrame, file: str, order: str, content: str) -> DataFrame:
    """(file, size, digest): the MD5 of a file's samples, of which each chunk (in `order`) gives what it has; places past its end give nothing.

    No file is put together: a chunk's place is a running sum of lengths, and of all chunks at most a sample's bytes for each place go on. Null contents are empty.
    """
    length = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    w = Window.partitionBy(file).orderBy(order)
    start = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumn("_n", length).withColumn("_start", start)
    low = lambda p: F.greatest(p, F.col("_start"))
    high = lambda p: F.least(p + SAMPLE, F.col("_start") + F.col("_n"))
    places = F.array(*[F.lit(p).cast("long") for p in PLACES])
    pieces = F.transform(F.filter(places, lambda p: low(p) < high(p)), lambda p: F.struct(p.alias("place"), low(p).alias("at"), F.substring(F.col(content), (low(p) - F.col("_start") + 1).cast("int"), (high(p) - low(p)).cast("int")).alias("bytes")))
    told = placed.select(file, "_n", pieces.alias("_pieces"))
    joined = lambda p: F.aggregate(F.array_sort(F.flatten(p)), F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["bytes"]))
    return told.groupBy(file).agg(F.sum("_n").alias("size"), F.collect_list("_pieces").alias("_p")).select(file, "size", F.md5(joined("_p")).alias("digest"))
