"""Requests, records and caches: validity, offsets, orphans, lifetimes, positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.links import host_key, is_digest, is_fetchable, page_count, part_href, upstream_status, valid_part
from foliant.registry import query, table


@query("""SELECT event_id, CASE WHEN s >= 500 OR s = 407 THEN 502 ELSE s END AS status FROM (SELECT event_id, CAST(400 + floor(value) % 200 AS INT) AS s FROM events)""")
def status_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", upstream_status((F.lit(400) + F.floor("value") % 200).cast("int")).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, count(*) FILTER (a >= 1 AND a <= b AND b BETWEEN 2 AND 99) AS valid FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS a, CAST(l_quantity AS INT) * 3 AS b FROM lineitem) GROUP BY ALL""")
def part_request(spark, sf_dir):
    v = valid_part((F.col("l_linenumber") - 1).cast("string"), (F.col("l_quantity").cast("int") * 3).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_if(v).alias("valid"))


@query("""SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'part=1&parts=' || (page_id % 99 + 1) AS href FROM pages""")
def part_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", part_href(F.col("url"), F.lit("1"), (F.col("page_id") % 99 + 1).cast("string")).alias("href"))


_URLS = "CASE page_id % 4 WHEN 0 THEN replace(url, 'https://', 'HTTPS://USER@') WHEN 1 THEN regexp_replace(url, '^(https?://[^/?#]+)', '\\1:443') WHEN 2 THEN regexp_replace(url, '^(https?://[^/?#]+)', '\\1:0') ELSE 'ftp:' || url END"


@query(rf"""WITH u AS (SELECT page_id, {_URLS} AS url FROM pages), p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*:(\d+)(?:[/?#]|$)', 1) AS port FROM u)
SELECT page_id, host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END AS host, scheme IN ('http', 'https') AND host <> '' AND port <> '0' AS fetchable FROM p""")
def host_keys(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.expr(_URLS.replace("'\\1", "'$1")).alias("url"))
    return u.select("page_id", host_key(F.col("url")).alias("host"), is_fetchable(F.col("url")).alias("fetchable"))


@query("""SELECT event_id, CASE WHEN regexp_matches(trim(n), '^[0-9]{1,9}$') THEN CAST(trim(n) AS INT) ELSE 0 END AS pages FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN user_id || 'x' ELSE CAST(event_id * 100003 AS VARCHAR) END AS n FROM events)""")
def page_counts(spark, sf_dir):
    i = F.col("event_id")
    n = F.when(i % 3 == 0, F.concat(F.lit(" "), "user_id", F.lit(" "))).when(i % 3 == 1, F.concat("user_id", F.lit("x"))).otherwise((i * 100003).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", page_count(n).alias("pages"))


@query("""SELECT doc_id, regexp_matches(d, '^[0-9a-fA-F]{32}$') AS legal FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(coalesce(text, '')) || 'g' ELSE upper(md5(coalesce(text, ''))) END AS d FROM documents)""")
def digest_legal(spark, sf_dir):
    digest = F.md5(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", is_digest(F.when(F.col("doc_id") % 3 == 0, F.concat(digest, F.lit("g"))).otherwise(F.upper(digest))).alias("legal"))


@query("""SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 1000000000) - doc_id AS span FROM documents""")
def record_offsets(spark, sf_dir):
    """Where each record of a book starts, and how far it is to the next; a book is written by one task, in this order."""
    w = Window.partitionBy("source").orderBy("doc_id")
    before = F.coalesce(F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "documents").select("source", "doc_id", before.cast("long").alias("at"), (F.lead("doc_id", 1, 1_000_000_000).over(w) - F.col("doc_id")).alias("span"))


@query("""SELECT doc_id, CAST(b AS INT) AS block, CAST(least(4096, n_chars - b * 4096) AS BIGINT) AS size FROM documents, LATERAL (SELECT unnest(generate_series(0, (n_chars - 1) // 4096)) AS b) WHERE n_chars > 0""")
def text_records(spark, sf_dir):
    """Texts in records of 4096."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / 4096).cast("int"))).alias("block"))
    return d.select("doc_id", "block", F.least(F.lit(4096), F.col("n_chars") - F.col("block") * 4096).cast("long").alias("size"))


@query("""SELECT o_orderkey FROM orders o WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 SECOND AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orphan_sweep(spark, sf_dir):
    """Records older than a minute without a body."""
    orders = table(spark, sf_dir, "orders")
    now = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 60 SECOND")).alias("limit"))
    return orders.join(F.broadcast(now)).where(F.col("o_orderdate") < F.col("limit")).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""WITH e AS (SELECT *, lag(ts) OVER w AS before, lag(value) OVER w AS held FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS asked, count(*) FILTER (before IS NOT NULL AND ts - before <= CASE WHEN held < 30 THEN INTERVAL 300 SECOND ELSE INTERVAL 900 SECOND END) AS fresh FROM e GROUP BY ALL""")
def ttl_cache(spark, sf_dir):
    """Questions that the answer before is still fresh for: 900 s, or 300 s for one that found nothing."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (t - F.lag(t).over(w)).alias("age"), F.lag("value").over(w).alias("held"))
    fresh = F.col("age") <= F.when(F.col("held") < 30, 300_000_000).otherwise(900_000_000)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("asked"), F.count_if(fresh).alias("fresh"))


@query("""WITH d AS (SELECT user_id, min(ts) AS over FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id, count(*) AS updates, arg_max(e.event_id, (e.ts, e.event_id)) AS last_event FROM events e LEFT JOIN d USING (user_id) WHERE d.over IS NULL OR e.ts <= d.over GROUP BY e.user_id""")
def ended_updates(spark, sf_dir):
    """Updates count until the first that ends a download; later ones change nothing."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("over", F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(w))
    return e.where("over is null or ts <= over").groupBy("user_id").agg(F.count("*").alias("updates"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: (x - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) / (list_stddev_pop(list_transform(embedding, lambda y: y::DOUBLE)) + 1e-6)) AS z FROM embeddings),
p AS (SELECT vec_id, z, lag(z) OVER (ORDER BY vec_id) AS b FROM z) SELECT vec_id, round(list_inner_product(z, b) / 64, 5) AS likeness FROM p WHERE b IS NOT NULL AND vec_id % 20 <> 0""")
def same_picture(spark, sf_dir):
    """The mean product of two pictures' standard scores, for pictures that follow each other in a book of twenty."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    d = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), mean.alias("m")).withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("v")) + 1e-6)
    z = d.select("vec_id", F.transform("v", lambda x: (x - F.col("m")) / F.col("s")).alias("z"))
    before = F.lag("z").over(Window.partitionBy(F.floor(F.col("vec_id") / 20)).orderBy("vec_id"))
    return z.select("vec_id", "z", before.alias("b")).where("b is not null").select("vec_id", F.round(F.aggregate(F.zip_with("z", "b", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / 64, 5).alias("likeness"))
