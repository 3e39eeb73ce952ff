"""Archives: names, natural order, parts, covers, keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.strings import decode_token, duration_text, encode_token, human_bytes, is_image, is_junk, natural_key, note
from foliant.operators.windows import exclusive_sum
from foliant.registry import query, table


@query(r"""WITH k AS (SELECT p_partkey, p_brand, p_name, list_transform(regexp_extract_all(lower(concat_ws(' ', p_brand, p_name)), '(\d+|\D+)'),
  lambda x: CASE WHEN regexp_matches(x, '^\d') THEN {'t': '', 'n': len(regexp_replace(x, '^0+(.)', '\1')), 'd': regexp_replace(x, '^0+(.)', '\1')} ELSE {'t': x, 'n': 0, 'd': ''} END) AS key, p_size FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY key, p_partkey) AS INT) AS page FROM k""")
def natural_order(spark, sf_dir):
    """Pages of each book (parts of a size) numbered in natural order."""
    parts = table(spark, sf_dir, "part").withColumn("key", natural_key(F.concat_ws(" ", "p_brand", "p_name")))
    return parts.select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy("key", "p_partkey")).alias("page"))


_PATHS = r"concat(CASE page_id % 6 WHEN 0 THEN '__MACOSX/._' WHEN 1 THEN 'book/.hidden/' WHEN 2 THEN 'book\desktop.ini' ELSE 'book/' END, 'p', page_id, CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' ELSE '' END)"


def _paths(spark, sf_dir):
    i = F.col("page_id")
    head = F.when(i % 6 == 0, "__MACOSX/._").when(i % 6 == 1, "book/.hidden/").when(i % 6 == 2, "book\\desktop.ini").otherwise("book/")
    tail = F.when(i % 5 == 0, ".PNG").when(i % 5 == 1, ".jpeg").when(i % 5 == 2, ".txt").when(i % 5 == 3, ".webp").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.lit("p"), i.cast("string"), tail).alias("name"))


@query(rf"""SELECT page_id, {_PATHS} AS name FROM pages WHERE len(list_filter(string_split_regex(lower({_PATHS}), '[\\/]'), lambda x: (starts_with(x, '.') AND x NOT IN ('.', '..')) OR x IN ('__macosx', 'thumbs.db', 'ehthumbs.db', 'desktop.ini'))) = 0""")
def junk_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(~is_junk(F.col("name")))


@query(rf"""SELECT page_id, {_PATHS} AS name FROM pages WHERE regexp_matches(lower({_PATHS}), '\.(avif|bmp|gif|hdp|j2k|jb2|jbig2|jp2|jpeg|jpg|jpx|jxl|jxr|pam|pbm|pgm|pkm|png|pnm|ppm|psd|tif|tiff|wdp|webp)$') AND NOT starts_with(string_split({_PATHS}, '/')[-1], '.')""")
def image_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(is_image(F.col("name")))


@query("""WITH s AS (SELECT role, conv_id, turn, octet_length(encode(text)) AS size FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(size) OVER (PARTITION BY role ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY role) AS total, count(*) OVER (PARTITION BY role) AS n,
  conv_id <> lag(conv_id) OVER w AS edge FROM s WINDOW w AS (PARTITION BY role ORDER BY conv_id, turn)),
t AS (SELECT DISTINCT role, k, total * k AS goal, total, n FROM p, (VALUES (1), (2), (3), (4)) v(k)),
b AS (SELECT t.role, k, coalesce(min(i) FILTER (5 * before >= goal), any_value(t.n)) AS j, any_value(t.goal) AS goal, any_value(t.total) AS total FROM t JOIN p USING (role) GROUP BY t.role, k),
e AS (SELECT b.role, k, b.j, b.total, arg_min(p.i, (abs(5 * p.before - b.goal), p.i)) AS near, min(abs(5 * p.before - b.goal)) AS off FROM b LEFT JOIN p ON p.role = b.role AND p.edge GROUP BY ALL),
c AS (SELECT role, k, CASE WHEN 2 * off <= total THEN near ELSE j END AS bound FROM e)
SELECT p.role, p.conv_id, p.turn, CAST(1 + count(c.k) AS BIGINT) AS part FROM p LEFT JOIN c ON c.role = p.role AND p.i >= c.bound GROUP BY p.role, p.conv_id, p.turn""")
def balanced_split(spark, sf_dir):
    """Five parts of about equal bytes; a bound moves to the nearest folder's edge if that is within half a part of bytes."""
    w = Window.partitionBy("role").orderBy("conv_id", "turn")
    all_rows = Window.partitionBy("role")
    s = table(spark, sf_dir, "conversations").where("text is not null").select("role", "conv_id", "turn", F.octet_length("text").alias("size"))
    p = s.select(
        "role", "conv_id", "turn", (F.row_number().over(w) - 1).alias("i"), exclusive_sum("size", ["role"], ["conv_id", "turn"]).alias("before"),
        F.sum("size").over(all_rows).alias("total"), F.count("*").over(all_rows).alias("n"), (F.col("conv_id") != F.lag("conv_id").over(w)).alias("edge"),
    )
    off = lambda k: F.abs(5 * F.col("before") - k * F.col("total"))
    ends = lambda k: F.coalesce(F.min(F.when(5 * F.col("before") >= k * F.col("total"), F.col("i"))), F.max("n"))
    near = lambda k: F.min(F.when(F.col("edge"), F.struct(off(k).alias("off"), F.col("i").alias("at"))))
    bounds = p.groupBy("role").agg(F.max("total").alias("total"), *[f(k).alias(f"{n}{k}") for k in range(1, 5) for n, f in (("end", ends), ("near", near))])
    cuts = bounds.select("role", F.array(*[F.when(2 * F.col(f"near{k}.off") <= F.col("total"), F.col(f"near{k}.at")).otherwise(F.col(f"end{k}")) for k in range(1, 5)]).alias("cuts"))
    return p.join(cuts, "role").select("role", "conv_id", "turn", (F.lit(1) + F.size(F.filter("cuts", lambda c: F.col("i") >= c))).cast("long").alias("part"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, greatest(1, n // 12) AS step FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM s WHERE i >= step // 2 AND (i - step // 2) % step = 0)
SELECT source, doc_id FROM t WHERE k <= 12""")
def systematic_sample(spark, sf_dir):
    w = Window.partitionBy("source")
    r = table(spark, sf_dir, "documents").select("source", "doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    s = r.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 12))).withColumn("half", F.floor(F.col("step") / 2))
    return s.where((F.col("i") >= F.col("half")) & ((F.col("i") - F.col("half")) % F.col("step") == 0) & ((F.col("i") - F.col("half")) / F.col("step") < 12)).select("source", "doc_id")


@query("SELECT page_id, rtrim(replace(replace(base64(encode(url)), '+', '-'), '/', '_'), '=') AS token, url AS back FROM pages")
def token_roundtrip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("token", encode_token(F.col("url")))
    return pages.select("page_id", "token", decode_token(F.col("token")).alias("back"))


@query("SELECT p_partkey, sha256(concat_ws(chr(0), 'v1', p_brand, p_type, CAST(p_size AS VARCHAR), p_name)) AS key FROM part")
def render_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("\u0000", F.lit("v1"), "p_brand", "p_type", F.col("p_size").cast("string"), "p_name"), 256).alias("key"))


@query("""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, md5(unhex(list_reduce(list_transform(list_prepend(0, list_transform(range(11), lambda i: 1024 * CAST(pow(4, i) AS BIGINT))), lambda a: substr(h, 2 * a + 1, 2048)), lambda x, y: x || y))) AS digest FROM b""")
def sparse_md5(spark, sf_dir):
    """MD5 of a kibibyte at 0 and at 1024 * 4^i, as far as the text goes."""
    raw = F.col("text").cast("binary")
    parts = [F.substring(F.coalesce(raw, F.lit("").cast("binary")), at + 1, 1024) for at in (0, *(1024 * 4**i for i in range(11)))]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(*parts)).alias("digest"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 3 * 997 + 1) AS n FROM documents)""")
def human_bytes_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", human_bytes(F.col("n_chars") * (F.col("doc_id") % 3 * 997 + 1)).alias("size"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' ELSE s // 86400 || ' d' END AS age FROM (SELECT o_orderkey, CAST(floor(o_totalprice / (o_orderkey % 4 * 900 + 1)) AS BIGINT) AS s FROM orders)""")
def duration_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", duration_text(F.floor(F.col("o_totalprice") / (F.col("o_orderkey") % 4 * 900 + 1))).alias("age"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 140 THEN rtrim(substr(t, 1, 139)) || '…' ELSE t END AS note FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)""")
def summary_ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", note(F.col("text")).alias("note"))


@query("SELECT doc_id, md5(regexp_replace(text, 'tion', '***', 'gi')) AS clean FROM documents")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", "(?i)tion", "***")).alias("clean"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4)
SELECT l_orderkey, CAST(i AS INT) AS part, 'Order ' || l_orderkey || ' (' || i || ' of ' || k || ')' AS title FROM (SELECT *, least(99, (lines + 1) // 2) AS k FROM n), LATERAL (SELECT unnest(generate_series(1, k)) AS i)""")
def explode_parts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines")).where("lines >= 4").withColumn("k", F.least(F.lit(99), F.floor((F.col("lines") + 1) / 2)))
    parts = n.select("l_orderkey", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("part"))
    return parts.select("l_orderkey", "part", F.concat(F.lit("Order "), "l_orderkey", F.lit(" ("), "part", F.lit(" of "), "k", F.lit(")")).alias("title"))


@query("""WITH n AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, CAST(k AS BIGINT) AS ahead FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN n USING (conv_id), LATERAL (SELECT unnest(generate_series(c.turn + 1, least(c.turn + 3, n.top))) AS k)""")
def prefetch_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    top = c.groupBy("conv_id").agg(F.max("turn").alias("top"))
    return c.join(top, "conv_id").where("turn < top").select("conv_id", "turn", F.explode(F.sequence(F.col("turn") + 1, F.least(F.col("turn") + 3, F.col("top")))).alias("ahead"))


@query("""SELECT conv_id, 0 AS seq, 'cover' AS kind FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT), role FROM conversations""")
def ordered_union(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("seq"), F.col("role").alias("kind"))
    return c.select("conv_id").distinct().select("conv_id", F.lit(0).alias("seq"), F.lit("cover").alias("kind")).unionByName(pages)


@query("""WITH f AS (SELECT p_size, p_brand, min(p_partkey) AS seen FROM part GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY seen) AS class FROM f)
SELECT p_partkey, CAST(class AS INT) AS class FROM part JOIN d USING (p_size, p_brand)""")
def renumber_distinct(spark, sf_dir):
    """Distinct values numbered by first appearance."""
    part = table(spark, sf_dir, "part")
    seen = part.groupBy("p_size", "p_brand").agg(F.min("p_partkey").alias("seen"))
    classes = seen.withColumn("class", F.row_number().over(Window.partitionBy("p_size").orderBy("seen")))
    return part.join(classes, ["p_size", "p_brand"]).select("p_partkey", "class")
