"""Repacked archives: totals, places, parts and copies, over conversations as books of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators.repack import archive_totals, repack
from foliant.registry import query, table

_NAME = "CASE WHEN turn % 7 = 5 THEN '__MACOSX/._' || turn WHEN turn % 5 = 4 THEN 'v' || (conv_id % 3) || '/n' || turn || '.txt' ELSE 'v' || (conv_id % 3) || '/p' || conv_id || '-' || turn || CASE WHEN turn % 2 = 0 THEN '.PNG' ELSE '.jpg' END END"
_ARCHIVE = "'books/' || (conv_id % 40) || '.cbz'"


def _entries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select(F.expr(_ARCHIVE).alias("archive"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.expr(_NAME).alias("name"), F.octet_length(body).cast("long").alias("file_size"), body.alias("content"))


_SQL = rf"""WITH e AS (SELECT {_ARCHIVE} AS archive, conv_id, turn, conv_id * 1000 + turn AS ordinal, {_NAME} AS name, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS sum FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


@query(_SQL + """ SELECT archive, count(*) FILTER (turn % 7 <> 5) AS entries, count(*) FILTER (turn % 7 <> 5 AND turn % 5 <> 4) AS images, count(*) FILTER (turn % 7 = 5) AS junk, CAST(coalesce(sum(size) FILTER (turn % 7 <> 5), 0) AS BIGINT) AS declared FROM e GROUP BY archive""")
def repack_totals(spark, sf_dir):
    return archive_totals(_entries(spark, sf_dir))


@query(_SQL + r""", k AS (SELECT *, turn % 5 <> 4 AS image, row_number() OVER (PARTITION BY archive ORDER BY conv_id % 3, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END, CASE WHEN turn % 5 = 4 THEN turn ELSE conv_id END, turn, conv_id) AS place FROM e WHERE turn % 7 <> 5),
i AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY place) AS page, coalesce(sum(size) OVER (PARTITION BY archive ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY archive) AS total, conv_id % 3 <> lag(conv_id % 3) OVER (PARTITION BY archive ORDER BY place) AS edge FROM k WHERE image),
b AS (SELECT archive, p, coalesce(min(page) FILTER (3 * before >= p * total), max(page) + 1) AS ends, arg_min(page, (abs(3 * before - p * total), page)) FILTER (edge) AS near, min(abs(3 * before - p * total)) FILTER (edge) AS off, any_value(total) AS total FROM i, (VALUES (1), (2)) v(p) GROUP BY archive, p),
c AS (SELECT archive, p, CASE WHEN 2 * off <= total THEN near ELSE ends END AS bound FROM b),
d AS (SELECT i.archive, i.place, i.page, i.turn, i.name, i.sum, 1 + count(c.p) AS part FROM i LEFT JOIN c ON c.archive = i.archive AND i.page >= c.bound GROUP BY ALL
  UNION ALL SELECT archive, place, NULL, turn, name, sum, unnest([1, 2, 3]) FROM k WHERE NOT image)
SELECT regexp_extract(archive, '(\d+)\.cbz$', 1) || ' (' || part || ' of 3).cbz' AS file, CAST(place AS BIGINT) AS place, CASE WHEN page IS NULL THEN name WHEN page < 10000 THEN lpad(CAST(page AS VARCHAR), 4, '0') || CASE WHEN turn % 2 = 0 THEN '.PNG' ELSE '.jpg' END END AS name, sum AS content_md5 FROM d""")
def repack_parts(spark, sf_dir):
    """Books in three parts: junk left out, images numbered on and dealt by bytes and folders, other entries in each part."""
    return repack(_entries(spark, sf_dir), 3).select("file", "place", "name", F.md5("content").alias("content_md5"))
