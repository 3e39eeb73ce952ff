"""The relational core of page images: row statistics, margins, tone, levels, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.stats import tone
from foliant.operators import bilateral
from foliant.registry import query, table


@query("""SELECT vec_id, list_min(embedding) AS lo, list_max(embedding) AS hi, round(list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS deviation FROM embeddings""")
def row_stats(spark, sf_dir):
    v = F.col("embedding")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.size(v)
    var = F.aggregate(F.transform(v, lambda x: F.pow(x.cast("double") - mean, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), F.round(F.sqrt(var), 6).alias("deviation"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY l_returnflag""")
def side_quartiles(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("""WITH h AS (SELECT l_returnflag, CAST(floor(l_quantity) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY level) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h)
SELECT l_returnflag, min(level) AS level FROM c WHERE upto * 2 >= total GROUP BY l_returnflag""")
def histogram_median(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor("l_quantity").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag")
    c = h.withColumn("upto", F.sum("n").over(w.orderBy("level"))).withColumn("total", F.sum("n").over(w))
    return c.where(F.col("upto") * 2 >= F.col("total")).groupBy("l_returnflag").agg(F.min("level").alias("level"))


@query("""WITH v AS (SELECT l_shipdate, l_returnflag, l_quantity * 5.1 AS v FROM lineitem)
SELECT l_returnflag, round(avg(pow(greatest(0.0, least(1.0, (v - 8) / 237.0)), 1 / 1.05) * 255), 6) AS toned FROM v GROUP BY l_returnflag""")
def tone_curve(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(tone(F.col("l_quantity") * 5.1, 8.0, 245.0, 1.05)), 6).alias("toned"))


@query("""WITH v AS (SELECT l_partkey // 50 AS cell, l_quantity / 10 AS z FROM lineitem), s AS (SELECT cell, floor(z) AS level, 1 - (z - floor(z)) AS w, z FROM v UNION ALL SELECT cell, floor(z) + 1, z - floor(z), z FROM v)
SELECT cell, CAST(level AS BIGINT) AS level, round(sum(w), 6) AS weight, round(sum(w * z), 6) AS total FROM s GROUP BY cell, level""")
def bilateral_grid(spark, sf_dir):
    """Weighted sums by cell and level; a value is split between the two levels about it."""
    z = F.col("l_quantity") / 10
    low = F.floor(z)
    v = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 50).alias("cell"), z.alias("z"), F.explode(F.array(F.struct(low.alias("level"), (1 - (z - low)).alias("w")), F.struct((low + 1).alias("level"), (z - low).alias("w")))).alias("s"))
    return v.groupBy("cell", F.col("s.level").alias("level")).agg(F.round(F.sum("s.w"), 6).alias("weight"), F.round(F.sum(F.col("s.w") * F.col("z")), 6).alias("total"))


@query("""WITH d AS (SELECT p_partkey, p_size * 40 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part), s AS (SELECT *, least(1264.0 / w, 1680.0 / h, 2.0) AS f FROM d)
SELECT p_partkey, CAST((1264 - least(1264, CAST(floor(w * f) AS BIGINT))) // 2 AS BIGINT) AS x, CAST((1680 - least(1680, CAST(floor(h * f) AS BIGINT))) // 2 AS BIGINT) AS y FROM s""")
def letterbox(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), F.floor("p_retailprice").alias("h"))
    s = d.withColumn("f", F.least(F.lit(1264.0) / F.col("w"), F.lit(1680.0) / F.col("h"), F.lit(2.0)))
    place = lambda side, n: F.floor((F.lit(n) - F.least(F.lit(n), F.floor(F.col(side) * F.col("f")))) / 2)
    return s.select("p_partkey", place("w", 1264).alias("x"), place("h", 1680).alias("y"))


# Reach of a square to alike levels and to cells about it; a level; how far a lightness may move.
NEAR, ACROSS, STEP, MOST_L = (0.050, 0.472, 1.0, 0.472, 0.050), (12 / 44, 20 / 44, 12 / 44), 2.5, 2.5
_SQUARES = "SELECT label AS page, vec_id % 400 AS y, CAST(unnest(range(64)) AS BIGINT) AS x, unnest(list_transform(embedding, lambda e: abs(e::DOUBLE) * 100)) AS value, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 - (vec_id % 3) / 4.0 END AS share FROM (SELECT min(vec_id) AS vec_id, label, arg_min(embedding, vec_id) AS embedding FROM embeddings WHERE label IS NOT NULL GROUP BY label, vec_id % 400)"


@query(rf"""WITH q AS ({_SQUARES}), n AS (SELECT page, max(y) // 4 + 1 AS rows, max(x) // 4 + 1 AS cols FROM q GROUP BY page),
p AS (SELECT page, y // 4 AS cy, x // 4 AS cx, l, share * CASE WHEN l = floor(value / 2.5) THEN 1 - (value / 2.5 - floor(value / 2.5)) ELSE value / 2.5 - floor(value / 2.5) END AS w, value FROM (SELECT *, unnest([floor(value / 2.5), floor(value / 2.5) + 1]) AS l FROM q WHERE share > 0)),
g AS (SELECT page, cy, cx, l, sum(w) AS w, sum(w * value) AS t FROM p GROUP BY ALL),
a AS (SELECT page, cy, cx, l + d AS l, sum(w * k) AS w, sum(t * k) AS t FROM g, (VALUES (-2, 0.05::DOUBLE), (-1, 0.472), (0, 1.0), (1, 0.472), (2, 0.05)) v(d, k) GROUP BY ALL),
b AS (SELECT a.page, r.r AS cy, cx, l, sum(w * k) AS w, sum(t * k) AS t FROM (SELECT page, unnest(range(rows)) AS r, rows FROM n) r, (VALUES (-1, 12::DOUBLE / 44), (0, 20::DOUBLE / 44), (1, 12::DOUBLE / 44)) v(d, k), a WHERE a.page = r.page AND a.cy = least(greatest(r.r + d, 0), r.rows - 1) GROUP BY ALL),
c AS (SELECT b.page, cy, r.r AS cx, l, sum(w * k) AS w, sum(t * k) AS t FROM (SELECT page, unnest(range(cols)) AS r, cols FROM n) r, (VALUES (-1, 12::DOUBLE / 44), (0, 20::DOUBLE / 44), (1, 12::DOUBLE / 44)) v(d, k), b WHERE b.page = r.page AND b.cx = least(greatest(r.r + d, 0), r.cols - 1) GROUP BY ALL),
s AS (SELECT page, y, x, value, (y + 2) // 4 - 1 + dy AS cy, (x + 2) // 4 - 1 + dx AS cx, floor(value / 2.5) + dl AS l, CASE WHEN dy = 1 THEN ((y + 2) % 4 + 0.5) / 4 ELSE 1 - ((y + 2) % 4 + 0.5) / 4 END * CASE WHEN dx = 1 THEN ((x + 2) % 4 + 0.5) / 4 ELSE 1 - ((x + 2) % 4 + 0.5) / 4 END * CASE WHEN dl = 1 THEN value / 2.5 - floor(value / 2.5) ELSE 1 - value / 2.5 + floor(value / 2.5) END AS w
  FROM q, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx), (VALUES (0), (1)) c(dl) WHERE share > 0)
SELECT s.page, s.y, s.x, round(any_value(value) + greatest(-2.5, least(2.5, sum(s.w * c.t) / sum(s.w * c.w) - any_value(value))), 6) AS smoothed FROM s JOIN c USING (page, cy, cx, l) GROUP BY s.page, s.y, s.x""")
def bilateral_means(spark, sf_dir):
    """Shades smoothed over what lies near and is alike, moved by 2.5 at most; a label's vectors are the rows of a page."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").groupBy("label", (F.col("vec_id") % 400).alias("y")).agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    share = F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(1 - (F.col("vec_id") % 3) / 4)
    q = e.select(F.col("label").alias("page"), "y", share.alias("share"), F.posexplode(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100)).alias("x", "value")).withColumn("x", F.col("x").cast("long"))
    means = bilateral.bilateral_means(q, "page", 4, STEP, NEAR, ACROSS)
    return q.join(means, ["page", "y", "x"]).select("page", "y", "x", F.round(bilateral.held_change(F.col("mean"), F.col("value"), MOST_L), 6).alias("smoothed"))
