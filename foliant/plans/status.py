"""Run-time metrics over the event stream: timings, rings, sessions, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.stats import floor_rank
from foliant.operators.windows import as_of, exclusive_sum, islands, newest
from foliant.registry import query, table

HIT, KEPT = 35.0, 500


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) rn FROM events)
SELECT event_type, count(*) AS served, count(*) FILTER (value <= {HIT}) AS hits, CAST(round_even(100.0 * count(*) FILTER (value <= {HIT}) / count(*), 0) AS BIGINT) AS share,
  round(median(value), 6) AS median_value, list_sort(list(value))[CAST(least(count(*), floor(count(*) * 0.9) + 1) AS BIGINT)] AS p90_value
FROM k WHERE rn <= {KEPT} GROUP BY event_type""")
def status_summary(spark, sf_dir):
    kept = newest(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], KEPT)
    hits = F.count_if(F.col("value") <= HIT)
    return kept.groupBy("event_type").agg(F.count("*").alias("served"), hits.alias("hits"), F.bround(100.0 * hits / F.count("*"), 0).cast("long").alias("share"), F.round(F.median("value"), 6).alias("median_value"), floor_rank(F.col("value"), 0.9).alias("p90_value"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn <= 20")
def last_n_ring(spark, sf_dir):
    return newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 900 SECOND THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS steps, min(event_id) AS first_event, max(ts) < any_value(now) - INTERVAL 900 SECOND AS lost FROM s, m GROUP BY user_id, session""")
def stale_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    s = events.withColumn("b", F.when(gap <= 900_000_000, 0).otherwise(1)).withColumn("session", F.sum("b").over(w))
    now = events.agg(F.max("t").alias("now"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("steps"), F.min("event_id").alias("first_event"), F.max("t").alias("t")).join(F.broadcast(now)).select("user_id", "session", "steps", "first_event", (F.col("t") < F.col("now") - 900_000_000).alias("lost"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def inflight_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_stream(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, doc_id, n_chars FROM r WHERE total - before > CAST(floor(0.9 * floor(0.6 * total)) AS BIGINT)""")
def lru_evict(spark, sf_dir):
    """The oldest go while what is left exceeds 90 % of the cap (60 % of the total); a cache for each source."""
    docs = table(spark, sf_dir, "documents")
    r = docs.select("source", "doc_id", "n_chars", exclusive_sum("n_chars", ["source"], ["doc_id"]).alias("before"), F.sum("n_chars").over(Window.partitionBy("source")).alias("total"))
    return r.where(F.col("total") - F.col("before") > F.floor(F.lit(0.9) * F.floor(F.lit(0.6) * F.col("total")))).select("source", "doc_id", "n_chars")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 10 OR rn <= 10 - 10 // 10""")
def lineage_prune(spark, sf_dir):
    """Of more than 10 records the newest 9 stay: a tenth goes, so that the next ones don't prune again."""
    w = Window.partitionBy("o_custkey")
    r = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).withColumn("n", F.count("*").over(w))
    return r.where("n <= 10 or rn <= 9").select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT event_type, floor(value) AS w, count(*) n, min(event_id) AS seen FROM events GROUP BY ALL)
SELECT event_type, CAST(arg_min(w, (-n, seen)) AS BIGINT) AS modal FROM c GROUP BY event_type""")
def mode_first_seen(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.floor("value").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return counts.groupBy("event_type").agg(F.min_by("w", F.struct(-F.col("n"), F.col("seen"))).alias("modal"))


@query("""WITH e AS (SELECT user_id, event_id, value <= 15 AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events),
g AS (SELECT *, rn - sum(q::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e)
SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM g WHERE q GROUP BY user_id, i HAVING count(*) >= 2""")
def gaps_islands(spark, sf_dir):
    return islands(table(spark, sf_dir, "events"), F.col("value") <= 15, ["user_id"], ["event_id"], 2)


@query("""WITH e AS (SELECT user_id, event_id, value <= 60 AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events),
g AS (SELECT *, rn - sum(q::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e),
r AS (SELECT user_id, min(event_id) AS f, max(event_id) AS l FROM g WHERE q GROUP BY user_id, i HAVING count(*) >= 2)
SELECT user_id, coalesce(max(f) FILTER (f < 5000), min(f) FILTER (f >= 5000)) AS cut FROM r GROUP BY user_id""")
def last_before_else_first_past(spark, sf_dir):
    runs = islands(table(spark, sf_dir, "events"), F.col("value") <= 60, ["user_id"], ["event_id"], 2)
    return runs.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("first") < 5000, F.col("first"))), F.min(F.when(F.col("first") >= 5000, F.col("first")))).alias("cut"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def moving_avg_shrink(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


@query("""WITH e AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS lo,
  first_value(value) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS hi, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round((s + greatest(0, 3 - rn) * lo + greatest(0, rn + 2 - n) * hi) / 5, 6) AS smooth FROM e""")
def moving_avg_edge(spark, sf_dir):
    """A frame of five in which the end values stand for what is beyond the ends."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rn, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("user_id"))
    padded = F.sum("value").over(w.rowsBetween(-2, 2)) + F.greatest(F.lit(0), 3 - rn) * F.first("value").over(whole) + F.greatest(F.lit(0), rn + 2 - n) * F.last("value").over(whole)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(padded / 5, 6).alias("smooth"))


@query("SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS d1, round(value - lag(value, 3) OVER w, 6) AS d3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def first_diff(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("d1"), F.round(F.col("value") - F.lag("value", 3).over(w), 6).alias("d3"))


@query("""SELECT p.user_id, p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_pages(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(buys, views, ["user_id"], "ts", ["view_id"]).select("user_id", "event_id", "view_id")


@query("""WITH d AS (SELECT user_id, event_type, max(event_id) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) rn FROM d)
SELECT user_id, array_to_string(list(event_type ORDER BY seen), '>') AS trail FROM r WHERE rn <= 3 GROUP BY user_id""")
def breadcrumb(spark, sf_dir):
    """The last three distinct steps of a user, in the order of their last use."""
    seen = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("seen"))
    kept = newest(seen, ["user_id"], [F.desc("seen")], 3)
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "event_type"))), lambda s: s["event_type"]), ">").alias("trail"))
