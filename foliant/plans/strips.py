"""Strips of rows cut into tiles, runs of row masks, plans of equal pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import masks
from foliant.operators.strips import Panel, even_starts, strip_features, strip_tiles
from foliant.registry import query, table

PANEL = Panel(1000, 200)

#: Rows of strips: a supplier's lines are a book, a line is white, black, grey, nearly white or a picture by its quantity and order.
_ROWS = """SELECT CAST(l_suppkey AS VARCHAR) AS book, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS row,
  CASE WHEN l_orderkey % 90 < 3 THEN 240 WHEN l_orderkey % 190 < 4 THEN 5 WHEN l_orderkey % 70 < 5 THEN 100 + CAST(l_quantity AS INT) % 30 ELSE CAST(l_quantity AS INT) % 8 END AS lo,
  CASE WHEN l_orderkey % 90 < 3 THEN 240 + CAST(l_quantity AS INT) % 18 WHEN l_orderkey % 190 < 4 THEN 12 + CAST(l_quantity AS INT) % 9 WHEN l_orderkey % 70 < 5 THEN 130 ELSE 250 END AS hi,
  l_quantity * l_discount AS busy, CAST(l_quantity AS INT) AS ink FROM lineitem"""


def strip_rows(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_strip_lines")
    return spark.sql(_ROWS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM _strip_lines")).withColumn("paper", F.col("hi") - F.col("lo") <= 15)


_LONG = lambda start, stop, low, high, least: f"least({stop}, {high}) - greatest({start}, {low}) >= {least}"


@query(rf"""WITH RECURSIVE r AS ({_ROWS}),
m AS (SELECT *, hi - lo <= 15 AS quiet, hi - lo <= 15 AND lo >= 235 AS white, hi - lo <= 15 AND hi <= 30 AS black, count(*) OVER (PARTITION BY book) AS n FROM r),
g AS (SELECT *, row - sum(CAST(quiet AS INT)) OVER w AS qi, row - sum(CAST(white AS INT)) OVER w AS wi, row - sum(CAST(black AS INT)) OVER w AS bi FROM m WINDOW w AS (PARTITION BY book ORDER BY row)),
x AS MATERIALIZED (SELECT *, min(row) OVER q AS qs, max(row) OVER q + 1 AS qe, min(row) OVER h AS ws, max(row) OVER h + 1 AS we, min(row) OVER b AS bs, max(row) OVER b + 1 AS be FROM g WINDOW q AS (PARTITION BY book, quiet, qi), h AS (PARTITION BY book, white, wi), b AS (PARTITION BY book, black, bi)),
t AS (SELECT DISTINCT book, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS before, n, CAST(NULL AS VARCHAR) AS tier, CAST(0 AS BIGINT) AS ink FROM x UNION ALL
  SELECT book, CASE WHEN n - pos <= 200 THEN n ELSE coalesce(gutter, pos + 200) END, pos, n, CASE WHEN n - pos <= 200 THEN 'end' WHEN gutter IS NOT NULL THEN 'gutter' ELSE 'limit' END, ink FROM (
    SELECT t.book, t.pos, t.n, CASE WHEN any_value(seam) IS NOT NULL THEN coalesce(max(row) FILTER (row BETWEEN greatest(ss, t.pos + 100) AND seam AND ((white AND {_LONG('ws', 'we', 'ss', 'se', 2)}) OR (black AND {_LONG('bs', 'be', 'ss', 'se', 2)}))), any_value(seam))
      ELSE coalesce(min(row) FILTER (row BETWEEN p AND pe - 1 AND ((white AND {_LONG('ws', 'we', 'p', 'pe', 2)}) OR (black AND {_LONG('bs', 'be', 'p', 'pe', 2)}))), min(row) FILTER (row BETWEEN p AND pe - 1 AND (white OR black)), any_value(p)) END AS gutter, CAST(0 AS BIGINT) AS ink
    FROM (SELECT t.book, t.pos, t.n, max(row) FILTER (row >= t.pos + 100 AND row < t.pos + 200 AND long) AS seam, greatest(t.pos, max_by(qs, row) FILTER (row >= t.pos + 100 AND row < t.pos + 200 AND long)) AS ss, least(t.pos + 400, max_by(qe, row) FILTER (row >= t.pos + 100 AND row < t.pos + 200 AND long)) AS se,
            min(row) FILTER (row >= t.pos + 200 AND long) AS p, least(t.pos + 400, min_by(qe, row) FILTER (row >= t.pos + 200 AND long)) AS pe
          FROM (SELECT t.*, x.row, x.qs, x.qe, x.quiet AND {_LONG('x.qs', 'x.qe', 't.pos', 't.pos + 400', 2)} AS long FROM t JOIN x ON x.book = t.book AND x.row >= t.pos AND x.row < t.pos + 400 WHERE t.pos < t.n) t GROUP BY t.book, t.pos, t.n) t
      JOIN x ON x.book = t.book AND x.row >= t.pos AND x.row < t.pos + 400 GROUP BY t.book, t.pos, t.n))
SELECT t.book, CAST(row_number() OVER (PARTITION BY t.book ORDER BY t.pos) AS INT) AS tile, t.before AS first, t.pos - 1 AS last, t.tier FROM t WHERE t.tier IS NOT NULL AND (SELECT sum(ink) FROM x WHERE x.book = t.book AND x.row >= t.before AND x.row < t.pos) > 6""")
def strip_seams(spark, sf_dir):
    """Tiles that end at gutters only, or at the panel's height: the last gutter in a tile's second half, the first one past it."""
    from dataclasses import replace

    return strip_tiles(strip_rows(spark, sf_dir), replace(PANEL, tiers=("gutter",), fill=False, skip_leading=False)).select("book", "tile", "first", "last", "tier")


@query()
def strip_cut(spark, sf_dir):
    """Tiles by every rule: gutters, loose gutters, paper, flat bands, pictures in equal pieces or one after another."""
    return strip_tiles(strip_rows(spark, sf_dir), PANEL)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 5 = 0 THEN 200 + CAST(floor(abs(x) * 20) AS INT) ELSE CAST(least(255, floor(abs(x) * 600)) AS INT) END) AS r FROM embeddings),
y AS (SELECT vec_id, r, list_transform(r, lambda x: x * 0.299::DOUBLE + (255 - x) * 0.587::DOUBLE + (x // 2) * 0.114::DOUBLE) AS y, list_concat(r, list_concat(list_transform(r, lambda x: 255 - x), list_transform(r, lambda x: x // 2))) AS a FROM v),
s AS (SELECT vec_id, list_min(a) AS lo, list_max(a) AS hi, list_avg(y) AS mean, list_stddev_pop(y) AS deviation, y FROM y),
o AS (SELECT *, len(list_filter(y, lambda v: abs(v - mean) > 24)) AS off_mean FROM s)
SELECT CAST(vec_id % 7 AS VARCHAR) AS book, vec_id AS row, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, hi - lo <= 15 OR (deviation <= 10 AND off_mean <= 0.0025 * len(y)) AS paper, CAST(CASE WHEN hi - lo > 48 THEN off_mean ELSE 0 END AS INT) AS ink FROM o""")
def strip_row_features(spark, sf_dir):
    single = lambda n: F.lit(n).cast("float")  # noqa: E731  products of single precision, as in SQL; a whole number would make them double
    shade = lambda x: F.when(F.col("vec_id") % 5 == 0, 200 + F.floor(F.abs(x) * single(20)).cast("int")).otherwise(F.least(F.lit(255), F.floor(F.abs(x) * single(600)).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("book"), F.col("vec_id").alias("row"), F.transform("embedding", shade).alias("red"))
    bands = rows.withColumn("green", F.transform("red", lambda x: 255 - x)).withColumn("blue", F.transform("red", lambda x: F.floor(x / 2).cast("int")))
    return strip_features(bands).select("book", "row", "lo", "hi", "paper", "ink")


@query("""WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS row, l_quantity, l_discount FROM lineitem),
a AS (SELECT l_suppkey, row, l_discount, min(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY row ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c FROM r WHERE row < 45),
p AS (SELECT x.l_suppkey, [0, y.row, z.row] AS starts, y.c + o.c + z.c AS cost FROM (SELECT DISTINCT l_suppkey FROM a) x JOIN a y ON y.l_suppkey = x.l_suppkey AND y.row BETWEEN 12 - 4 AND 12 - 1 JOIN a o ON o.l_suppkey = x.l_suppkey AND o.row = y.row + 12 JOIN a z ON z.l_suppkey = x.l_suppkey AND z.row BETWEEN y.row + 12 - 4 AND y.row + 12 - 1 WHERE z.row + 12 >= 30)
SELECT l_suppkey, array_to_string(arg_min(starts, (cost, starts)), ' ') AS starts, min(cost) AS cost FROM p GROUP BY l_suppkey""")
def even_plan(spark, sf_dir):
    """Three pieces of twelve rows over a supplier's first lines, cut where the least quantities are; each begins one to four rows before the last one ends."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.row_number().over(w) - 1).cast("long").alias("row"), "l_quantity")
    calm = rows.withColumn("calm", F.min("l_quantity").over(Window.partitionBy("l_suppkey").orderBy("row").rowsBetween(0, 11))).where("row < 45")
    found = even_starts(calm, ["l_suppkey"], "row", "calm", 3, 12, 1, 4, F.col("row") + 12 >= 30)
    return found.select("l_suppkey", F.array_join(F.transform("starts", lambda s: s.cast("string")), " ").alias("starts"), "cost")


_MASKS = """r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS row, l_quantity > 15 AS a, l_discount > 0.04 AS b FROM lineitem)"""


def _two_masks(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", (F.row_number().over(w) - 1).alias("row"), (F.col("l_quantity") > 15).alias("a"), (F.col("l_discount") > 0.04).alias("b"))


@query(f"""WITH {_MASKS}, o AS (SELECT l_suppkey, row, unnest(['and', 'or', 'minus', 'not']) AS how, unnest([a AND b, a OR b, a AND NOT b, NOT a]) AS v FROM r),
i AS (SELECT *, row - row_number() OVER (PARTITION BY l_suppkey, how ORDER BY row) AS i FROM o WHERE v)
SELECT l_suppkey, how, min(row) AS start, max(row) + 1 AS stop FROM i GROUP BY l_suppkey, how, i""")
def mask_algebra(spark, sf_dir):
    """AND, OR, AND NOT and NOT of two row masks, from runs to runs; the rows are numbered once."""
    a, b, every = F.col("a"), F.col("b"), F.col("every")
    named = F.array_compact(F.array(F.lit("every"), F.when(a, "a"), F.when(b, "b")))
    on = _two_masks(spark, sf_dir).select("l_suppkey", "row", F.explode(named).alias("mask"))
    runs = masks.mask_runs(on, ["l_suppkey", "mask"], "row", F.lit(True))
    out = masks.algebra(runs, ["l_suppkey"], "mask", ["a", "b", "every"], {"and": a & b, "or": a | b, "minus": a & ~b, "not": every & ~a})
    return out.select("l_suppkey", "how", "start", "stop")


@query(f"""WITH {_MASKS}, i AS (SELECT *, row - sum(CAST(a AS INT)) OVER (PARTITION BY l_suppkey ORDER BY row) AS i FROM r)
SELECT l_suppkey, row, CASE WHEN a THEN min(row) OVER (PARTITION BY l_suppkey, a, i) END AS start, CASE WHEN a THEN max(row) OVER (PARTITION BY l_suppkey, a, i) + 1 END AS stop FROM i""")
def mask_run_at(spark, sf_dir):
    """The run that holds each row, if one does."""
    rows = _two_masks(spark, sf_dir)
    a = masks.mask_runs(rows, ["l_suppkey"], "row", F.col("a"))
    return masks.run_at(a, rows.select("l_suppkey", F.col("row").cast("long").alias("row")), ["l_suppkey"], "row")
