"""Numbers and records of e-book containers: variable-width integers, base-32 names, aligned records, interned strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Digits of base-32 names; bytes of a record of strings; bytes of an index block beside its entries.
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
STRING_RECORD, INDEX_BLOCK, TEXT_RECORD = 65536 - 1024, 65536 - 192 - 1048, 4096


def _groups(n: Column) -> Column:
    """The 7-bit groups of a number, the highest first; at least one."""
    size = F.greatest(F.lit(1), F.ceil((F.length(F.bin(n))) / 7)).cast("int")
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.call_function("shiftright", n, (size - i) * 7).bitwiseAND(F.lit(127)))


def _bytes(groups: Column) -> Column:
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(g), 2, "0")), ""))


def forward_varint(n: Column) -> Column:
    """Big-endian groups of seven bits; the last has its high bit set."""
    g = _groups(n.cast("long"))
    return _bytes(F.transform(g, lambda x, i: F.when(i == F.size(g) - 1, x.bitwiseOR(F.lit(128))).otherwise(x)))


def backward_varint(n: Column) -> Column:
    """Big-endian groups of seven bits, read from the end; the first has its high bit set."""
    return _bytes(F.transform(_groups(n.cast("long")), lambda x, i: F.when(i == 0, x.bitwiseOR(F.lit(128))).otherwise(x)))


def base32(n: Column, digits: int = 1) -> Column:
    """At least `digits` digits of base 32."""
    text = F.upper(F.conv(n.cast("string"), 10, 32))
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def aligned(raw: Column) -> Column:
    """Bytes, with zeros up to a multiple of four."""
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(raw), F.lit(4)).cast("int"))))


def blocked(rows: DataFrame, book: str, order: list[str], size: str, limit: int) -> DataFrame:
    """`rows` with `block` and `place`: taken in order into blocks of at most `limit` bytes; a row that doesn't fit into what is left begins the next block, and may be all of it.

    Where a block begins depends on all before it, so a book's rows pass one task as a sorted stream; it holds a batch of them and two numbers. Null books are one book, null sizes are 0.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, used, empty = None, -1, 0, True
        for b in batches:
            books, sizes = b.column(book).to_pylist(), b.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            blocks, places = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            edges = [0, *(i for i in range(1, b.num_rows) if books[i] != books[i - 1]), b.num_rows]
            for begin, end in zip(edges[:-1], edges[1:]):
                if block < 0 or books[begin] != last:
                    last, block, used, empty = books[begin], 0, 0, True
                total, at = np.concatenate(([0], np.cumsum(sizes[begin:end]))), 0
                while at < end - begin:  # a step a block, not a row
                    stop = max(int(np.searchsorted(total, total[at] + limit - used, side="right")) - 1, at + empty)
                    blocks[begin + at : begin + stop], places[begin + at : begin + stop] = block, used + total[at:stop] - total[at]
                    used, empty, at = used + int(total[stop] - total[at]), empty and stop == at, stop
                    if at < end - begin:
                        block, used, empty = block + 1, 0, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks), pa.array(places)], [*b.schema.names, "block", "place"])

    schema = StructType([*rows.schema.fields, StructField("block", LongType()), StructField("place", LongType())])
    return rows.repartition(book).sortWithinPartitions(book, *order).mapInArrow(place, schema)


def interned(rows: DataFrame, book: str, order: str, text: str, limit: int = STRING_RECORD) -> DataFrame:
    """(book, text, offset): where each distinct text of a book is in its string records, by first use; an offset is record * 65536 + place."""
    length = F.octet_length(F.encode(text, "UTF-8"))
    firsts = rows.groupBy(book, text).agg(F.min(order).alias("_at")).withColumn("_size", F.octet_length(forward_varint(length)) + length)
    placed = blocked(firsts.select(book, F.col("_at"), F.col(text), F.col("_size")), book, ["_at", text], "_size", limit)
    return placed.select(book, text, (F.col("block") * 65536 + F.col("place")).alias("offset"))


def index_blocks(rows: DataFrame, book: str, order: str, size: str, limit: int = INDEX_BLOCK) -> DataFrame:
    """`rows` (book, order, size) with `block`: index entries of `size` bytes in order, packed into blocks of at most `limit` bytes; each entry takes two more for its place."""
    own = rows.select(book, order, size, (F.col(size) + 2).alias("_size"))
    return blocked(own, book, [order], "_size", limit).select(book, order, size, "block")


def first_overlap(records: DataFrame, entries: DataFrame, book: str) -> DataFrame:
    """`records` (book, start, stop) with `first` and `n`: of the `entries` (book, at, size, in order) those that the record's bytes meet.

    first: the number of the first entry that ends after the record's start; n: how many start before its stop from there on.
    """
    lists = entries.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("_e"))
    ended = F.size(F.filter("_e", lambda e: e["at"] + e["size"] <= F.col("start")))
    begun = F.size(F.filter("_e", lambda e: e["at"] < F.col("stop")))
    return records.join(lists, book).select(*records.columns, ended.cast("long").alias("first"), F.greatest(F.lit(0), begun - ended).cast("long").alias("n"))


def part_copies(entries: DataFrame, part: Column, parts: Column, everywhere: Column) -> DataFrame:
    """`entries` with `part`: what goes `everywhere` once for each part, the rest to its own."""
    return entries.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(1), parts)).otherwise(F.array(part))))


def later_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
