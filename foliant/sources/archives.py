"""ZIP archives as rows of entries, and books of pages as ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.links import suffix_of
from foliant.functions.strings import is_image, is_junk, natural_key

ENTRIES = "archive string, ordinal int, name string, file_size long, compress_size long, method int, offset long, content binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives that `path` matches, without directories; an archive is read by one task.

    An archive that can't be read gives no rows; an entry that can't has a null content.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    file = zipfile.ZipFile(pa.BufferReader(data.as_buffer()))
                except (zipfile.BadZipFile, OSError):
                    continue
                for i, e in enumerate(file.infolist()):
                    if not e.is_dir():
                        try:
                            content = file.read(e)
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError):
                            content = None
                        row = (path, i, e.filename, e.file_size, e.compress_size, e.compress_type, e.header_offset, content)
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], [c.split()[0] for c in ENTRIES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(explode, ENTRIES)


def in_order(entries: DataFrame) -> DataFrame:
    """`entries` without junk, with `kind` (page or copy) and `page`: images count from 1 in natural order, others are null."""
    kept = entries.where(~is_junk(F.col("name"))).withColumn("kind", F.when(is_image(F.col("name")), "page").otherwise("copy"))
    w = Window.partitionBy("archive", "kind").orderBy(natural_key(F.col("name")), "ordinal")
    return kept.withColumn("page", F.when(F.col("kind") == "page", F.row_number().over(w)))


def named(pages: DataFrame, digits: int = 4) -> DataFrame:
    """Pages under padded numbers with the suffix that their bytes ask for; copies keep their names."""
    text = F.col("page").cast("string")
    number = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return pages.withColumn("name", F.when(F.col("kind") == "page", F.concat(number, suffix_of(F.col("content"), F.col("name")))).otherwise(F.col("name")))


def to_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): a stored ZIP for each archive, pages first, in order. A book is one file and so one task's work."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for row in p.sort_values(["page", "ordinal"], na_position="last").itertuples():
                if row.content is not None:
                    z.writestr(zipfile.ZipInfo(row.name), row.content)
        return pd.DataFrame({"archive": [key[0]], "content": [out.getvalue()]})

    return pages.select("archive", "ordinal", "page", "name", "content").groupBy("archive").applyInPandas(build, "archive string, content binary")
