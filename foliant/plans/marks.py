"""Components of marks and peaks of spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import marks, masks
from foliant.registry import query, table

_CELLS = "SELECT DISTINCT l_suppkey AS page, l_partkey % 28 AS y, (l_orderkey * 7 + l_linenumber) % 40 AS x FROM lineitem WHERE l_quantity < 18"


def _mask_runs(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").where("l_quantity < 18").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 28).alias("y"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 40).alias("x")).distinct()
    return masks.mask_runs(cells, ["page", "y"], "x", F.lit(True))


@query(f"""WITH RECURSIVE c AS ({_CELLS}), e AS (SELECT a.page, a.y, a.x, b.y AS oy, b.x AS ox FROM c a JOIN c b ON a.page = b.page AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT page, y, x, y AS ry, x AS rx FROM c UNION SELECT r.page, e.oy, e.ox, r.ry, r.rx FROM r JOIN e ON e.page = r.page AND e.y = r.y AND e.x = r.x),
l AS (SELECT page, y, x, min(ry * 1000 + rx) AS label FROM r GROUP BY page, y, x)
SELECT page, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(count(*) AS BIGINT) AS ink FROM l GROUP BY page, label""")
def mark_boxes(spark, sf_dir):
    """Boxes of the components of a mask a page."""
    return marks.component_boxes(_mask_runs(spark, sf_dir), "page")


@query("""WITH v AS (SELECT label AS page, vec_id % 500 AS y, list_transform(embedding, lambda e: CAST(floor(abs(e) * 1000) AS BIGINT)) AS e FROM embeddings WHERE label IS NOT NULL), c AS (SELECT page, y, unnest(range(64)) AS x, unnest(e) AS v FROM v),
f AS (SELECT page, quantile_cont(v, 0.5) FILTER (y % 4 = 0 AND x % 4 = 0) AS floor, max(y) + 1 AS h FROM c GROUP BY page),
k AS (SELECT c.* FROM c JOIN f USING (page) WHERE v > greatest(coalesce(floor, 0) * 3, 200) AND NOT (x < 8 AND (y < 6 OR y >= h - 6))),
p1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY v DESC, y, x) = 1),
k2 AS (SELECT k.* FROM k JOIN p1 p ON p.page = k.page WHERE abs(k.y - p.y) > 5 OR abs(k.x - p.x) > 4), p2 AS (SELECT * FROM k2 QUALIFY row_number() OVER (PARTITION BY page ORDER BY v DESC, y, x) = 1),
k3 AS (SELECT k.* FROM k2 k JOIN p2 p ON p.page = k.page WHERE abs(k.y - p.y) > 5 OR abs(k.x - p.x) > 4), p3 AS (SELECT * FROM k3 QUALIFY row_number() OVER (PARTITION BY page ORDER BY v DESC, y, x) = 1)
SELECT page, CAST(1 AS INT) AS peak, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v FROM p1 UNION ALL SELECT page, 2, y, x, v FROM p2 UNION ALL SELECT page, 3, y, x, v FROM p3""")
def spectrum_tops(spark, sf_dir):
    """Three peaks of the vectors of a label as a spectrum, each of which strikes what is about it."""
    v = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").alias("page"), (F.col("vec_id") % 500).alias("y"), F.posexplode(F.transform("embedding", lambda e: F.floor(F.abs(e) * F.lit(1000).cast("float")))).alias("x", "v"))
    found = marks.spectrum_peaks(v.withColumn("x", F.col("x").cast("long")), "page", 3, 5, 4, 3.0, 200.0, 6, 8)
    return found.select("page", "peak", "y", "x", "v")
