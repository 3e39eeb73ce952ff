"""Names, addresses, headers and records, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import addresses, names, records, rewriting
from foliant.registry import query, table

_HREFS = "CASE page_id % 6 WHEN 0 THEN 'https://x.org/a' || page_id WHEN 1 THEN '//cdn.org/p' || page_id WHEN 2 THEN '/root/./x/../' || page_id WHEN 3 THEN 'rel/' || page_id WHEN 4 THEN '../up/' || page_id ELSE '?q=' || page_id END"


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://x.org/a' || page_id WHEN 1 THEN 'https://cdn.org/p' || page_id WHEN 2 THEN 'https://cat.org/root/' || page_id WHEN 3 THEN 'https://cat.org/opds/v1/rel/' || page_id
 WHEN 4 THEN 'https://cat.org/opds/up/' || page_id ELSE 'https://cat.org/opds/v1/list?q=' || page_id END AS url FROM pages""")
def resolved_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_HREFS).alias("href"))
    return pages.select("page_id", addresses.resolve(F.lit("https://cat.org/opds/v1/list?x=1"), F.col("href")).alias("url"))


_TEMPLATES = "CASE p_partkey % 8 WHEN 0 THEN '/s?q={searchTerms}' WHEN 1 THEN '/s{?query}' WHEN 2 THEN '/s?a=1{&query,page}' WHEN 3 THEN '/s/{query:3}' WHEN 4 THEN '/s/{search*}/x' WHEN 5 THEN '/s/{lang?}/x' WHEN 6 THEN '/s/{other}' ELSE '/s{?other}{query?}' END || p_partkey"


@query("""WITH t AS (SELECT p_partkey, p_name || ' ä/&' AS term, replace(replace(replace(replace(p_name || ' ä/&', ' ', '%20'), 'ä', '%C3%A4'), '/', '%2F'), '&', '%26') AS q FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '/s?q=' || q WHEN 1 THEN '/s?query=' || q WHEN 2 THEN '/s?a=1&query=' || q WHEN 3 THEN '/s/' || replace(substr(term, 1, 3), ' ', '%20') WHEN 4 THEN '/s/' || q || '/x' WHEN 5 THEN '/s//x' WHEN 6 THEN '/s/{other}' ELSE '/s' || q END || p_partkey AS href FROM t""")
def filled_searches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEMPLATES).alias("template"), F.concat("p_name", F.lit(" ä/&")).alias("term"))
    return parts.select("p_partkey", addresses.fill_search(F.col("template"), F.col("term")).alias("href"))


@query("""SELECT page_id, rtrim(replace(replace(base64(encode('https://cat.org/api/opds/~key~/image?id=' || page_id || CASE WHEN page_id % 2 = 0 THEN chr(10) || url ELSE '' END)), '+', '-'), '/', '_'), '=') AS token,
 'https://cat.org/api/opds/S3CRET/image?id=' || page_id AS back, CASE WHEN page_id % 2 = 0 THEN url END AS cover FROM pages""")
def sealed_tokens(spark, sf_dir):
    url = F.concat(F.lit("https://cat.org/api/opds/S3CRET/image?id="), "page_id")
    pages = table(spark, sf_dir, "pages").withColumn("token", addresses.sealed_token(url, F.when(F.col("page_id") % 2 == 0, F.col("url")), "S3CRET"))
    opened = pages.select("page_id", "token", addresses.opened_token(F.col("token"), "S3CRET").alias("o"))
    return opened.select("page_id", "token", F.col("o.url").alias("back"), F.col("o.cover").alias("cover"))


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'p' WHEN 1 THEN 'img' WHEN 2 THEN 'dl' WHEN 3 THEN 's' ELSE 'f' END AS kind FROM part),
t AS (SELECT *, rtrim(replace(replace(base64(encode('https://cat.org/b/' || p_partkey || CASE kind WHEN 'p' THEN '/{pageNumber}' WHEN 's' THEN '?q={searchTerms}' WHEN 'dl' THEN chr(10) || 'https://cat.org/c/' || p_partkey ELSE '' END)), '+', '-'), '/', '_'), '=') AS token FROM k)
SELECT p_partkey, 'http://me/dev/' || CASE kind WHEN 'p' THEN 'p/' || token || '?page={pageNumber}&maxWidth={maxWidth}' || CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN '&count=' || p_partkey ELSE '' END WHEN 's' THEN 's/' || token || '?q={searchTerms}' ELSE kind || '/' || token END AS href FROM t""")
def mapped_links(spark, sf_dir):
    """Links of every kind as they lead to this server."""
    i = F.col("p_partkey")
    kind = F.when(i % 5 == 0, "p").when(i % 5 == 1, "img").when(i % 5 == 2, "dl").when(i % 5 == 3, "s").otherwise("f")
    href = F.concat(F.lit("/b/"), i, F.when(i % 5 == 0, "/{pageNumber}").when(i % 5 == 3, "?q={searchTerms}").otherwise("{?unused}"))
    links = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), href.alias("href"), F.concat(F.lit("/c/"), i).alias("cover"), F.when(i % 2 == 0, i).otherwise(0).alias("count"))
    return links.select("p_partkey", addresses.map_href(F.col("href"), F.col("kind"), F.lit("https://cat.org/"), addresses.Context("dev", "http://me"), F.col("cover"), F.col("count")).alias("href"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 3 = 0 AS long, 'http://me/dev/dl/' || rtrim(replace(replace(base64(encode('https://cat.org/a/' || p_partkey)), '+', '-'), '/', '_'), '=') AS href FROM part),
e AS (SELECT *, k FROM t, LATERAL (SELECT unnest(CASE WHEN long THEN [1, 2] ELSE [0] END) AS k))
SELECT p_partkey, '<feed>' || string_agg('<entry><title>B' || p_partkey || CASE WHEN k > 0 THEN ' (' || k || ' of 2)' ELSE '' END || '</title><link rel="http://opds-spec.org/acquisition" href="' || href || CASE WHEN k > 0 THEN '?part=' || k || '&amp;parts=2' ELSE '' END || '"/></entry>', '' ORDER BY k) || '</feed>' AS feed FROM e GROUP BY p_partkey""")
def rewritten_feeds(spark, sf_dir):
    """A feed for each part, rewritten as a document; every third book is long and becomes two."""
    i = F.col("p_partkey")
    feed = F.concat(F.lit("<feed><entry><title>B"), i, F.lit('</title><link rel="http://opds-spec.org/acquisition" href="/a/'), i, F.lit('"/></entry></feed>'))
    split = lambda href, pages: F.when(F.regexp_extract(href, r"(\d+)$", 1).cast("long") % 3 == 0, 2).otherwise(1)
    # the table is small and its files are few, the work on a row is not: keys alone are dealt to all tasks
    parts = table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    feeds = parts.select("p_partkey", feed.alias("feed"))
    return feeds.withColumn("feed", rewriting.rewrite_atom(F.col("feed"), F.lit("https://cat.org/"), addresses.Context("dev", "http://me"), parts=split))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'attachment; filename="' || p_name || ' (2 of 3).cbz"' WHEN p_partkey % 3 = 1 THEN 'attachment; filename="' || p_name || '_ (2 of 3)"; filename*=UTF-8''''' || replace(p_name, ' ', '%20') || '%C3%A9%20%282%20of%203%29' ELSE 'attachment; filename="_ (2 of 3)._x"; filename*=UTF-8''''%C3%A9%20%282%20of%203%29.%22x' END AS header FROM part""")
def attachment_headers(spark, sf_dir):
    i = F.col("p_partkey")
    name = F.when(i % 3 == 0, F.concat("p_name", F.lit(".cbz"))).when(i % 3 == 1, F.concat("p_name", F.lit("é"))).otherwise('é."x')
    return table(spark, sf_dir, "part").select("p_partkey", names.attachment(names.part_name(name, F.lit(2), F.lit(3))).alias("header"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.cbz' WHEN 1 THEN 'é ' || p_partkey WHEN 2 THEN 'last ' || p_partkey || '.zip' ELSE 'download' END AS name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'é ' || p_partkey WHEN 2 THEN 'last ' || p_partkey ELSE 'download' END AS title FROM part""")
def download_names(spark, sf_dir):
    i = F.col("p_partkey")
    header = F.when(i % 4 == 0, F.concat(F.lit('attachment; filename="'), "p_name", F.lit('.cbz"'))).when(i % 4 == 1, F.concat(F.lit("attachment; filename=\"x\"; filename*=UTF-8''%C3%A9%20"), i)).otherwise("")
    url = F.when(i % 4 == 2, F.concat(F.lit("https://cat.org/a/last%20"), i, F.lit(".zip/?q=/x"))).otherwise("https://cat.org")
    name = names.file_name(header, url)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), names.kindle_title(name).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS series, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS volume FROM orders""")
def path_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://cat.org/api/Opds/"), F.when(k % 3 == 0, F.lit("all")).when(k % 3 == 1, F.concat(F.lit("Series/"), "o_custkey", F.lit("/volume/"), k, F.lit("/chapter/1"))).otherwise(F.concat(F.lit("series/"), "o_custkey")), F.lit("?series/9"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.series_and_volume(url).alias("i")).select("o_orderkey", "i.series", "i.volume")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id WHEN event_id % 4 = 1 THEN event_id ELSE 0 END AS page FROM events""")
def query_ints(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit(" "), "user_id")).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.concat(F.lit("-"), i + 1)).otherwise(F.concat(i, F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", names.query_int(raw).alias("page"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN user_id + 1 WHEN 2 THEN 7 END AS page, CASE event_id % 8 WHEN 1 THEN true WHEN 2 THEN false END AS completed FROM events""")
def progress_reports(spark, sf_dir):
    """Reports that hold a page from 1, whether the book is completed, or both; the others are refused whole."""
    i = F.col("event_id") % 8
    raw = (
        F.when(i == 0, F.concat(F.lit('{"page": '), F.col("user_id") + 1, F.lit("}"))).when(i == 1, '{"completed": true}').when(i == 2, '{"page": 7, "completed": false}').when(i == 3, '{"page": "7"}')
        .when(i == 4, '{"page": 0}').when(i == 5, "{}").when(i == 6, '{"page": 3, "more": 1}').otherwise(F.concat(F.lit('{"page": 3'), F.repeat(F.lit(" "), F.lit(2000)), F.lit("}")))
    )
    return table(spark, sf_dir, "events").select("event_id", names.progress_body(raw).alias("r")).select("event_id", "r.page", "r.completed")


@query("""WITH h AS (SELECT user_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('book:' || user_id)) AS h FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def name_uuids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", names.uuid5(F.concat(F.lit("book:"), "user_id")).alias("id"))


def _varint_sql(last: bool) -> str:
    """Each group of seven bits by itself, as many as the number has; the mark is on the last or on the first."""
    group = lambda i, n: f"printf('%02X', ((o_orderkey >> {7 * (n - 1 - i)}) & 127) | {128 if i == (n - 1 if last else 0) else 0})"
    whens = " ".join(f"WHEN o_orderkey < {1 << 7 * n} THEN {' || '.join(group(i, n) for i in range(n))}" for n in range(1, 9))
    return f"CASE {whens} END"


@query(f"""SELECT o_orderkey, {_varint_sql(True)} AS forward, {_varint_sql(False)} AS backward,
 list_aggregate(list_transform(range(5, -1, -1), lambda i: substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', CAST((o_orderkey >> (5 * i)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS base32 FROM orders""")
def varints(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(records.forward_varint(k)).alias("forward"), F.hex(records.backward_varint(k)).alias("backward"), records.base32(k, 6).alias("base32"))


@query("""WITH RECURSIVE f AS (SELECT conv_id % 50 AS book, text, min(conv_id * 100 + turn) AS pos, octet_length(encode(text)) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
s AS (SELECT book, text, n + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 ELSE 3 END AS n, row_number() OVER (PARTITION BY book ORDER BY pos, text) AS i FROM f),
r(book, i, record, used, place) AS (SELECT book, i, 0, n, 0 FROM s WHERE i = 1 UNION ALL SELECT s.book, s.i, CASE WHEN r.used + n > 4096 THEN record + 1 ELSE record END, CASE WHEN r.used + n > 4096 THEN n ELSE r.used + n END, CASE WHEN r.used + n > 4096 THEN 0 ELSE r.used END FROM r JOIN s ON s.book = r.book AND s.i = r.i + 1)
SELECT book, md5(text) AS text, CAST(record * 65536 + place AS BIGINT) AS at_byte FROM r JOIN s USING (book, i)""")
def interned_strings(spark, sf_dir):
    """Offsets of distinct texts in string records of 4096 bytes, in fifty books of conversations."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") % 50).alias("book"), "text", (F.col("conv_id") * 100 + F.col("turn")).alias("at"))
    return records.interned(c, "book", "at", "text", 4096).select("book", F.md5("text").alias("text"), F.col("offset").alias("at_byte"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey, 20 + o_orderkey % 300 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r(o_custkey, i, block, used) AS (SELECT o_custkey, i, 0, n + 2 FROM s WHERE i = 1 UNION ALL SELECT s.o_custkey, s.i, CASE WHEN r.used + n + 2 > 1000 THEN block + 1 ELSE block END, CASE WHEN r.used + n + 2 > 1000 THEN n + 2 ELSE r.used + n + 2 END FROM r JOIN s ON s.o_custkey = r.o_custkey AND s.i = r.i + 1)
SELECT o_custkey, o_orderkey, CAST(block AS BIGINT) AS block FROM r JOIN s USING (o_custkey, i)""")
def index_block_numbers(spark, sf_dir):
    """A customer's orders as index entries of 20 to 319 bytes, in blocks of a thousand."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (20 + F.col("o_orderkey") % 300).alias("size"))
    return records.index_blocks(o, "o_custkey", "o_orderkey", "size", 1000).select("o_custkey", "o_orderkey", "block")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS pos, 1 + o_orderkey % 5 AS size FROM orders), r AS (SELECT DISTINCT o_custkey, pos AS start, pos + 4000 AS stop FROM o)
SELECT r.o_custkey, r.start, count(*) FILTER (o.pos + o.size <= r.start) AS first, greatest(0, count(*) FILTER (o.pos < r.stop) - count(*) FILTER (o.pos + o.size <= r.start)) AS n FROM r JOIN o USING (o_custkey) GROUP BY ALL""")
def overlapping_entries(spark, sf_dir):
    """For each span of a customer's keys, the first entry that ends in it or after it, and how many begin before its end."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("at"), (1 + F.col("o_orderkey") % 5).alias("size"))
    r = o.select("o_custkey", F.col("at").alias("start"), (F.col("at") + 4000).alias("stop")).distinct()
    return records.first_overlap(r, o, "o_custkey").select("o_custkey", "start", "first", "n")


@query("""SELECT CAST(k AS INT) AS part, l_orderkey, l_linenumber, count(*) AS n FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN [1, 2, 3] ELSE [l_orderkey % 3 + 1] END AS ks FROM lineitem), LATERAL (SELECT unnest(ks) AS k) GROUP BY ALL""")
def part_copies(spark, sf_dir):
    """What every part holds, and what one does."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    own = records.part_copies(rows, (F.col("l_orderkey") % 3 + 1).cast("int"), F.lit(3), F.col("l_linenumber") == 1)
    return own.groupBy("part", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, starts_with(t, '<') OR starts_with(t, '{') AS feed, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN true ELSE false END AS looks FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<?xml version="1.0"?><feed>' WHEN 1 THEN '{"href": 1}' WHEN 2 THEN '<html>' ELSE 'plain' END AS t FROM documents)""")
def feed_sniff(spark, sf_dir):
    i = F.col("doc_id") % 4
    text = F.concat(F.lit("﻿ \n"), F.when(i == 0, '<?xml version="1.0"?><feed>').when(i == 1, '{"href": 1}').when(i == 2, "<html>").otherwise("plain"))
    return table(spark, sf_dir, "documents").select("doc_id", rewriting.is_feed(F.lit("text/plain; charset=x"), text).alias("feed"), rewriting.looks_like_feed(text).alias("looks"))
