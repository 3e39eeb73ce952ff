"""Catalogue feeds: links, hosts, search templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.links import ACQUISITION, IMAGE_RELS, JSON_TYPES, NAV_RELS, SEARCH_VARIABLES, STREAM_REL, classify
from foliant.registry import query, table

_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_RELS = r"string_split_regex(trim(rel), '\s+')"
_KIND = rf"""CASE WHEN list_contains({_RELS}, '{STREAM_REL}') OR contains(href, '{{pageNumber}}') THEN 'p' WHEN list_has_any({_RELS}, [{_LIST(IMAGE_RELS)}]) THEN 'img' WHEN contains(lower(type), 'opensearchdescription') THEN 'osd'
 WHEN len(list_filter({_RELS}, lambda r: starts_with(r, '{ACQUISITION}'))) > 0 THEN 'dl'
 WHEN regexp_matches(href, '\{{[?&]?(?:[^{{}}]*,)?\s*(?:{"|".join(SEARCH_VARIABLES)})\*?(?::[^{{}},]*)?\??\s*(?:,[^{{}}]*)?\}}') THEN 's'
 WHEN contains(lower(type), 'atom+xml') OR {" OR ".join(f"contains(lower(type), '{t}')" for t in JSON_TYPES)} THEN 'f' WHEN starts_with(lower(type), 'image/') THEN 'img' WHEN list_has_any({_RELS}, [{_LIST(NAV_RELS)}]) THEN 'f' ELSE 'dl' END"""
_LINKS = [
    ("http://opds-spec.org/acquisition", "application/zip", "/a.cbz"), ("http://opds-spec.org/image", "image/png", "/c.png"), ("next", "", "/feed?page=2"),
    ("search", "", "/s?q={searchTerms}"), ("stream", "image/jpeg", "/p/{pageNumber}"), ("search x", "", "/s{?page,query:20}"), ("alternate http://opds-spec.org/cover", "", "/c"), ("", "application/opensearchdescription+xml", "/osd"), ("self", "application/atom+xml;profile=opds-catalog", "/"), ("related", "text/html", "/x"), ("alternate", "image/gif", "/thumb"),
]
_VALUES = ", ".join(f"('{r}', '{t}', '{h}')" for r, t, h in _LINKS)


@query(f"""WITH l AS (SELECT * FROM (VALUES {_VALUES}) v(rel, type, href) UNION ALL SELECT '', '', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages)
SELECT {_KIND} AS kind, count(*) AS links FROM l GROUP BY 1""")
def link_classify(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.lit("").alias("rel"), F.lit("").alias("type"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return spark.createDataFrame(_LINKS, "rel string, type string, href string").unionByName(found).withColumn("kind", classify(F.col("rel"), F.col("type"), F.col("href"))).groupBy("kind").agg(F.count("*").alias("links"))


@query(r"""SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages WHERE regexp_matches(url, '^https?://[^/:?#]+') GROUP BY 1""")
def url_host_allow(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).where("host is not null")
    return hosts.groupBy("host").agg(F.count("*").alias("pages"))


@query("""WITH t AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS term FROM benchmark)
SELECT item_id, regexp_replace('/s?q={searchTerms}{&page}', '\\{[?&][^{}]*\\}', '') AS template, replace('/s?q={searchTerms}', '{searchTerms}', url_encode(term)) AS href FROM t""")
def search_expand(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.split("text", " ")[0]).alias("term"))
    return t.select("item_id", F.regexp_replace(F.lit("/s?q={searchTerms}{&page}"), r"\{[?&][^{}]*\}", "").alias("template"), F.replace(F.lit("/s?q={searchTerms}"), F.lit("{searchTerms}"), F.replace(F.url_encode("term"), F.lit("+"), F.lit("%20"))).alias("href"))
