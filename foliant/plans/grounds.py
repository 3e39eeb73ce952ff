"""Grounds of pages over lines of orders as lines of a border."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import grounds
from foliant.registry import query, table

_BORDER = """SELECT l_orderkey AS page, l_linenumber % 5 <> 4 AS flat, l_linenumber % 3 = 0 AS ends, (l_orderkey * 37) % 4 * 80 + CAST(l_quantity AS INT) % 9 AS r, (l_orderkey * 11) % 3 * 100 + CAST(l_quantity AS INT) % 7 AS g, CASE WHEN l_orderkey % 5 = 0 THEN 3 WHEN l_linenumber = 1 THEN 250 ELSE 120 + l_orderkey % 9 END AS b FROM lineitem"""
_CANDIDATES = """SELECT o_orderkey AS page, unnest([0, 1, 2]) AS no, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 255 ELSE 0 END, (o_orderkey * 37) % 4 * 80, (o_orderkey * 37) % 4 * 80 + 4]) AS r, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 255 ELSE 0 END, (o_orderkey * 11) % 3 * 100 + 3, (o_orderkey * 11) % 3 * 100]) AS g, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 255 ELSE 0 END, 124, 4]) AS b FROM orders"""


def _border(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_border_lines")
    return spark.sql(_BORDER.replace("FROM lineitem", "FROM _border_lines"))


@query(f"""SELECT page, {', '.join(f"CAST(round_even(quantile_cont({c}, 0.5), 0) AS INT) AS {c}" for c in 'rgb')} FROM ({_BORDER}) GROUP BY page""")
def border_grounds(spark, sf_dir):
    """The median colour of each order's lines."""
    return grounds.border_ground(_border(spark, sf_dir), "page")


@query(f"""WITH b AS ({_BORDER}), k AS ({_CANDIDATES}),
j AS (SELECT b.*, k.no, b.flat AND greatest(abs(b.r - k.r), abs(b.g - k.g), abs(b.b - k.b)) <= 12 AS covered, greatest(abs(b.r - n.r), abs(b.g - n.g), abs(b.b - n.b)) <= 12 AS held, greatest(abs(k.r - n.r), abs(k.g - n.g), abs(k.b - n.b)) > 12 AS apart, n.r AS now FROM b JOIN k USING (page) JOIN k n ON n.page = b.page AND n.no = 0),
s AS (SELECT page, no, now, avg(flat::INT) AS flats, bool_or(flat AND NOT held) AS other, bool_or(apart) AS apart, avg(covered::INT) AS share, avg(covered::INT) FILTER (ends) AS e, avg(covered::INT) FILTER (NOT ends) AS o, avg(r) FILTER (covered) AS r, avg(g) FILTER (covered) AS g, avg(b) FILTER (covered) AS b FROM j GROUP BY page, no, now),
w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY share DESC, no) AS rank, max(e) FILTER (no = 0) OVER (PARTITION BY page) AS e0, max(o) FILTER (no = 0) OVER (PARTITION BY page) AS o0, bool_or(apart) OVER (PARTITION BY page) AS any_apart FROM s),
f AS (SELECT page, now, r, g, b, CASE WHEN greatest(r, g, b) <= 12 THEN 0.0 WHEN least(r, g, b) >= 243 THEN 255.0 END AS pure FROM w WHERE rank = 1 AND no <> 0 AND flats >= 0.3 AND other AND any_apart AND share >= 0.3 AND coalesce(e >= e0, true) AND coalesce(o >= o0, true))
SELECT page, {', '.join(f"round(coalesce(pure, {c})::DOUBLE, 6) AS {c}" for c in 'rgb')} FROM f WHERE pure IS NULL OR pure <> now""")
def covering_colours(spark, sf_dir):
    """The colour that each order's padding takes, of three, if not its present black or white."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("_border_orders")
    zipped = _CANDIDATES.replace("unnest([0, 1, 2]) AS no, unnest([", "inline(arrays_zip(array(0, 1, 2), array(").replace("]) AS r, unnest([", "), array(").replace("]) AS g, unnest([", "), array(").replace("]) AS b FROM orders", "))) AS (no, r, g, b) FROM _border_orders")
    found = grounds.covering_colour(_border(spark, sf_dir), spark.sql(zipped), "page")
    return found.select("page", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in "rgb"])
