"""Look-ups that the page server does, as joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.registry import query, table


@query("SELECT n_nationkey, n_name, coalesce(r_name, '?') AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def dim_lookup(spark, sf_dir):
    regions = table(spark, sf_dir, "region")  # one row for each region of the world
    return table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("?")).alias("region"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS volumes, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey)
SELECT c_custkey, n_name, coalesce(volumes, 0) AS volumes, coalesce(newest, -c_custkey) AS cover FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def enrich_metadata(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("volumes"), F.max("o_orderkey").alias("newest"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.select("c_custkey", "n_name", F.coalesce("volumes", F.lit(0)).alias("volumes"), F.coalesce("newest", -F.col("c_custkey")).alias("cover"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def cache_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def cache_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(hits, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT conv_id, list(turn ORDER BY turn) AS pages FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(q AS INT) AS page, pages[greatest(1, least(q, len(pages)))] AS source FROM p, (VALUES (0), (1), (3), (99)) v(q)""")
def position_clamp(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("pages"))
    q = p.withColumn("page", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(99))))
    return q.select("conv_id", "page", F.element_at("pages", F.greatest(F.lit(1), F.least("page", F.size("pages")))).alias("source"))


@query("""WITH d AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)
SELECT doc_id, CAST(a // 4096 AS BIGINT) AS first_record, CAST((b - 1) // 4096 - a // 4096 + 1 AS BIGINT) AS records FROM d WHERE b > a""")
def interval_overlap(spark, sf_dir):
    """The 4096-byte text records that each document's span meets; spans follow each other, so a division finds them."""
    from foliant.operators.windows import exclusive_sum

    d = table(spark, sf_dir, "documents").select("doc_id", exclusive_sum("n_chars", ["source"], ["doc_id"]).alias("a"), "n_chars").withColumn("b", F.col("a") + F.col("n_chars")).where("b > a")
    first = F.floor(F.col("a") / 4096)
    return d.select("doc_id", first.alias("first_record"), (F.floor((F.col("b") - 1) / 4096) - first + 1).alias("records"))


@query("""SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size < a.p_size AND b.p_retailprice > a.p_retailprice)""")
def spatial_semi(spark, sf_dir):
    """Those with a smaller and dearer one of the brand: a window of what is smaller, not a join."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "part").withColumn("top", F.max("p_retailprice").over(w)).where("top > p_retailprice").select("p_partkey")


@query("SELECT CASE WHEN p_type LIKE '%BRASS%' THEN 'Colour' WHEN p_size > 25 THEN 'Webtoon' ELSE 'Black and white' END AS display_group, count(*) AS profiles FROM part GROUP BY 1")
def group_counts(spark, sf_dir):
    group = F.when(F.col("p_type").like("%BRASS%"), "Colour").when(F.col("p_size") > 25, "Webtoon").otherwise("Black and white")
    return table(spark, sf_dir, "part").groupBy(group.alias("display_group")).agg(F.count("*").alias("profiles"))


@query("SELECT s_suppkey, nullif(s_name, 'Supplier#000000001') AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier")
def sentinel_clean(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_name", F.lit("Supplier#000000001")).alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
