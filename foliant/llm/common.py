"""What the training-data operators share: the shared folder, written tables, running totals, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine (local[...]) an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so that a lost executor costs no more than its own tasks."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of write_table() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Views of at most `rows` rows, and of about `size` bytes: Spark bounds a batch's bytes, this bounds what Python makes objects of at once."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over bounded slices of Spark's batches."""
    return df.mapInArrow(lambda batches: f(slices(batches, rows)), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Each row with the sums of `totals` over all rows before it in `order` (a unique key), without a single-task window.

    Rows are dealt out in ranges and written; each range is summed on its own, and what precedes a range is added.
    The table of range sums has one row for each partition.
    """
    ranged = write_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    names = list(totals)
    sums = ranged.groupBy("_range").agg(*[F.sum(totals[n]).alias(f"_sum_{n}") for n in names])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(totals[n]).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names])
    return (
        rows.join(F.broadcast(bases), "_range")
        .withColumns({n: (F.col(f"_in_{n}") + F.col(f"_base_{n}")).cast("long") for n in names})
        .drop("_range", *[f"_in_{n}" for n in names], *[f"_base_{n}" for n in names])
    )


def group_of_equal(rows: DataFrame, key: str, id_column: str, name: str, salts: int = 16) -> DataFrame:
    """`rows` with `name`, the least id among the rows of the same key. Ids aren't null.

    Ids of one key are combined before they are shuffled. Only keys that repeat are joined back, once for each salt, so
    that a hot key's rows are dealt over several tasks.
    """
    groups = rows.groupBy(key).agg(F.min(id_column).alias(name), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int"))
    return own.join(salted, [key, "_salt"], "left").drop("_salt").withColumn(name, F.coalesce(name, id_column))


#: Rounds before components() gives up: they grow with the logarithm of the longest path.
ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the smallest node that can be reached.

    Alternating large and small stars. No neighbour list is gathered: each round only takes the least neighbour of a node,
    and Spark combines that before it shuffles. Each round is written to the shared folder. Empty edges: empty result. It goes on until
    nothing changes, and raises after ROUNDS.
    """
    known = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        found = write_table(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        drop_table(known)
        known = found
        now = known.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    nodes = known.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
