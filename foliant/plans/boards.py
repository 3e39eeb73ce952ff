"""Boards, caches and digests of files in chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.digests import sampled_md5
from foliant.registry import query, table
from foliant.streaming.boards import board_stands


@query("""WITH e AS (SELECT event_type AS board, ts, user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS done, row_number() OVER (PARTITION BY event_type ORDER BY ts, CAST(user_id AS VARCHAR), event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY board, user_id ORDER BY i) AS pi, lag(ts) OVER (PARTITION BY board, user_id ORDER BY i) AS pts, lag(ts) OVER (PARTITION BY board ORDER BY i) AS ats FROM e),
b AS (SELECT p.board, p.i, count(DISTINCT x.user_id) AS others FROM p JOIN e x ON x.board = p.board AND x.i > p.pi AND x.i < p.i GROUP BY p.board, p.i),
l AS (SELECT p.*, pi IS NULL OR coalesce(others, 0) >= 64 OR (pi < p.i - 1 AND ats - pts > INTERVAL 43200 SECOND) AS fresh FROM p LEFT JOIN b ON b.board = p.board AND b.i = p.i),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY board, user_id ORDER BY i) AS life FROM l)
SELECT board, event_id, CAST(user_id AS VARCHAR) AS job, coalesce(last_value(done IGNORE NULLS) OVER (PARTITION BY board, user_id, life ORDER BY i), 0) AS done FROM g""")
def board_progress(spark, sf_dir):
    """How users' jobs stand on boards by type of event: 64 jobs, for half a day after an update; what an update doesn't say stays."""
    e = table(spark, sf_dir, "events")
    done = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    updates = e.select(F.col("event_type").alias("board"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("job"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("stage"), done.alias("done"), F.lit(None).cast("long").alias("total"))
    return board_stands(updates, 64, 43200).select("board", F.col("stage").cast("long").alias("event_id"), "job", "done")


@query("""WITH f AS (SELECT conv_id, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY turn, role, text) AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CAST(len(h) // 2 AS BIGINT) AS size, md5(unhex(list_reduce(list_transform(list_prepend(0, list_transform(range(11), lambda i: 1024 * CAST(pow(4, i) AS BIGINT))), lambda a: substr(h, 2 * a + 1, 2048)), lambda x, y: x || y))) AS digest FROM f""")
def chunked_digests(spark, sf_dir):
    """Digests of conversations as files whose chunks are their rows."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", F.struct("turn", "role", "text").alias("place"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return sampled_md5(c, "conv_id", "place", "content")
