"""Catalogues, metadata and profiles as documents: each query writes its documents from the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import documents, profiles
from foliant.registry import query, table

_PARTS = "p_partkey"
_LINKS = [  # every how many parts, rel, type, href
    (5, "http://opds-spec.org/image/thumbnail", "image/png", "/t/"), (3, "subsection", "application/atom+xml", "/f/"), (7, "x http://opds-spec.org/image", "image/png", "/c/"), (2, "http://opds-spec.org/acquisition", "application/zip", "/a/"),
]


@query("""SELECT p_partkey // 20 AS feed, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Untitled' ELSE p_name || ' & <co>' END AS title, CASE WHEN p_partkey % 2 = 0 THEN '/a/' ELSE '/f/' END || p_partkey AS href,
 CASE WHEN p_partkey % 7 = 0 THEN '/c/' || p_partkey WHEN p_partkey % 5 = 0 THEN '/t/' || p_partkey END AS cover, p_partkey % 2 = 0 AS download FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def browse_feed(spark, sf_dir):
    """Atom feeds of twenty entries: what leads to a download or a feed, and its cover."""
    links = [F.when(F.col(_PARTS) % k == 0, F.concat(F.lit(f'<link rel="{rel}" type="{mime}" href="{href}'), F.col(_PARTS), F.lit('"/>'))).otherwise("") for k, rel, mime, href in _LINKS]
    title = F.when(F.col(_PARTS) % 11 == 0, " ").otherwise(F.concat(documents.xml_text(F.col("p_name")), F.lit(" &amp;\n &lt;co&gt;")))
    entry = F.concat(F.lit("<entry><title>"), title, F.lit("</title><id>"), F.col(_PARTS), F.lit("</id>"), *links, F.lit("</entry>"))
    feeds = table(spark, sf_dir, "part").groupBy(F.floor(F.col(_PARTS) / 20).alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(_PARTS).alias("k"), entry.alias("e")))), lambda s: s["e"]), "").alias("entries"))
    xml = feeds.select("feed", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), "entries", F.lit("</feed>")).alias("xml"))
    rows = documents.browse(xml, "xml")
    return rows.select("feed", F.regexp_extract("href", r"(\d+)$", 1).cast("long").alias("p_partkey"), "title", "href", "cover", "download")


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN '/s?q={searchTerms}&n=' || item_id WHEN 1 THEN '/t{?page,query*}' END AS template FROM benchmark""")
def search_description(spark, sf_dir):
    i = F.col("item_id")
    url = lambda t: F.concat(F.lit('<Url type="a" template="'), t, F.lit('"/>'))
    urls = F.when(i % 4 == 0, F.concat(url(F.lit("/x{?page}")), url(F.concat(F.lit("/s?q={searchTerms}&amp;n="), i)), url(F.lit("/late{query}")))).when(i % 4 == 1, url(F.lit("/t{?page,query*}"))).when(i % 4 == 2, url(F.lit("/none"))).otherwise("<broken")
    xml = F.concat(F.lit('<OpenSearchDescription xmlns="http://a9.com/-/spec/opensearch/1.1/">'), urls, F.lit("</OpenSearchDescription>"))
    return table(spark, sf_dir, "benchmark").select("item_id", documents.search_template(xml).alias("template"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ann Lee|' || s_name WHEN 1 THEN s_name ELSE '' END AS authors, s_suppkey % 4 <> 3 AND s_nationkey % 2 = 0 AS right_to_left FROM supplier""")
def comic_authors(spark, sf_dir):
    s = F.col("s_suppkey")
    by = F.when(s % 4 == 0, F.concat(F.lit("<Writer> Ann  Lee ,"), "s_name", F.lit(",Ann Lee,, </Writer><Penciller>no</Penciller>"))).when(s % 4 == 1, F.concat(F.lit("<Writer> </Writer><Penciller>"), "s_name", F.lit("</Penciller>"))).when(s % 4 == 2, "").otherwise("<Writer>")
    xml = F.concat(F.lit("<ComicInfo>"), by, F.when(F.col("s_nationkey") % 2 == 0, "<Manga>YesAndRightToLeft</Manga>").otherwise("<Manga>No</Manga>"), F.lit("</ComicInfo>"))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", documents.comic_info(xml).alias("i"))
    return found.select("s_suppkey", F.array_join("i.authors", "|").alias("authors"), F.col("i.right_to_left").alias("right_to_left"))


@query("""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN turn % 2 = 0 THEN ' ImageWidth="' || length(text) || '" ImageHeight="' || turn || '"' ELSE '' END AS size FROM conversations)
SELECT conv_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ComicInfo xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:xsd="http://www.w3.org/2001/XMLSchema">' || chr(10) || '  <Title>Talk ' || conv_id || ' &lt;&amp;&gt;</Title>' || chr(10) ||
 CASE WHEN conv_id % 2 = 0 THEN '  <Number>' || conv_id || '</Number>' || chr(10) ELSE '' END || '  <PageCount>' || count(*) || '</PageCount>' || chr(10) || '  <Pages>' || chr(10) ||
 string_agg('    <Page Image="' || i || '"' || CASE WHEN i = 0 THEN ' Type="FrontCover"' ELSE '' END || coalesce(size, '') || ' />' || chr(10), '' ORDER BY i) || '  </Pages>' || chr(10) || '</ComicInfo>' || chr(10)) AS digest FROM p GROUP BY conv_id""")
def comic_build(spark, sf_dir):
    """A ComicInfo text for each conversation as a book, its turns as pages; a digest of it."""
    size = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.length("text")).alias("width"), F.col("turn").alias("height"))
    books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(size)).alias("sizes"))
    fields = {"PageCount": F.size("sizes"), "Number": F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")), "Title": F.concat(F.lit("Talk "), "conv_id", F.lit(" <&>"))}
    return books.select("conv_id", F.md5(documents.comic_xml(fields, F.col("sizes"))).alias("digest"))


@query("""WITH p AS (SELECT page_id, 'Page ' || page_id AS title, CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id END AS pages, CASE WHEN page_id % 2 = 0 THEN '/c/' || page_id END AS cover FROM pages WHERE page_id % 5 <> 4)
SELECT page_id, title, pages, cover, 'links' AS container, CASE page_id % 3 WHEN 0 THEN 'alternate' WHEN 1 THEN 'alternate http://opds-spec.org/cover' ELSE '' END AS rel, '/l/' || page_id AS href, CASE page_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'img' ELSE 'dl' END AS kind FROM p
UNION ALL SELECT page_id, title, pages, cover, 'images', '', '/c/' || page_id, 'img' FROM p WHERE page_id % 2 = 0""")
def manifest_feed(spark, sf_dir):
    """JSON manifests: links with their kinds, rel as a text or a list; what can't be read gives nothing."""
    p = F.col("page_id")
    rel = F.when(p % 3 == 0, '"rel": "alternate", ').when(p % 3 == 1, '"rel": ["alternate", "http://opds-spec.org/cover"], ').otherwise("")
    images = F.when(p % 2 == 0, F.concat(F.lit(', "images": [{"href": "/c/'), p, F.lit('", "type": "text/html"}, {"type": "image/png"}]'))).otherwise("")
    count = F.when(p % 4 == 0, F.lit('"many"')).otherwise(p.cast("string"))
    text = F.concat(F.lit('{"metadata": {"title": "Page '), p, F.lit('", "numberOfPages": '), count, F.lit('}, "links": [{'), rel, F.lit('"href": "/l/'), p, F.lit('"}]'), images, F.when(p % 5 == 4, "").otherwise("}"))
    rows = documents.manifest_links(table(spark, sf_dir, "pages").select("page_id", text.alias("json")), "json")
    return rows.select("page_id", "title", "pages", "cover", "container", "rel", "href", "kind")


@query("""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST((conv_id * 7 + turn * turn) % 4 AS VARCHAR) AS step FROM conversations),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen FROM (SELECT DISTINCT conv_id FROM s)
 UNION ALL SELECT w.conv_id, s.i, CASE WHEN list_contains(seen, step) THEN seen[1:list_position(seen, step)] ELSE list_append(seen, step) END FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1)
SELECT conv_id, array_to_string(arg_max(seen, i)[-3:], '>') AS trail FROM w GROUP BY conv_id""")
def breadcrumb_cut(spark, sf_dir):
    """The trail of each conversation: going back to a step cuts what came after it; the last three stay."""
    step = ((F.col("conv_id") * 7 + F.col("turn") * F.col("turn")) % 4).cast("string")
    steps = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("step")))), lambda s: s["step"]).alias("steps"))
    return steps.select("conv_id", F.array_join(documents.trail(F.col("steps"), 3), ">").alias("trail"))


def _raw_profiles(spark, sf_dir):
    """A tree of profiles: each part inherits from the part of half its number; part 1 from nothing, every 97th from one that isn't there."""
    part = table(spark, sf_dir, "part")
    base = F.when(F.col(_PARTS) % 97 == 0, "none").when(F.col(_PARTS) > 1, F.concat(F.lit("p"), F.floor(F.col(_PARTS) / 2)))
    fields = F.array_compact(F.array(F.when(F.col(_PARTS) % 3 == 1, F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value"))), F.when(F.col(_PARTS) % 5 == 1, F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value"))), F.struct(F.lit("name").alias("field"), F.col("p_name").alias("value"))))
    return part.select(F.concat(F.lit("p"), F.col(_PARTS)).alias("name"), base.alias("base"), (F.col(_PARTS) % 13 == 12).alias("is_mixin"), F.inline(fields))


_CHAIN = """RECURSIVE c(k, a, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, a // 2, depth + 1 FROM c WHERE a > 1 AND a % 97 <> 0 AND a // 2 IN (SELECT p_partkey FROM part))"""


@query(f"""WITH {_CHAIN}, f AS (SELECT k, depth, unnest([{{'field': 'size', 'value': CASE WHEN a % 3 = 1 THEN CAST(p_size AS VARCHAR) END}}, {{'field': 'brand', 'value': CASE WHEN a % 5 = 1 THEN p_brand END}}, {{'field': 'name', 'value': p_name}}]) AS s FROM c JOIN part ON p_partkey = a WHERE k % 13 <> 12)
SELECT 'p' || k AS name, s.field AS field, arg_min(s.value, depth) AS value FROM f WHERE s.value IS NOT NULL GROUP BY ALL""")
def profile_inherit(spark, sf_dir):
    return profiles.inherited(_raw_profiles(spark, sf_dir))


@query(f"""WITH {_CHAIN} SELECT 'p' || k AS name, CAST(max(depth) AS INT) AS depth, CASE WHEN min(a) % 97 = 0 THEN 'unknown base' END AS problem FROM c GROUP BY k""")
def profile_chain(spark, sf_dir):
    """How deep each profile's chain goes, and what ends it before its root."""
    return profiles.chains(_raw_profiles(spark, sf_dir))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size - 25 < 0 THEN 'descreen_deadband' END, CASE WHEN p_size / 30.0 > 1 THEN 'defringe_strength' END, CASE WHEN p_size - 2 <= 0 THEN 'gamma' END, CASE WHEN p_size * 3 > 100 THEN 'jpeg_quality' END,
 CASE WHEN p_size > 9 THEN 'png_compression' END, CASE WHEN NOT (p_size * 4 < 200 - p_size) THEN 'black, white' END], lambda x: x IS NOT NULL), ';') AS problems FROM part""")
def profile_problems(spark, sf_dir):
    """Every rule that a profile breaks, together."""
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", (size - 25).alias("descreen_deadband"), (size / 30.0).alias("defringe_strength"), (size - 2).alias("gamma"), (size * 3).alias("jpeg_quality"), size.alias("png_compression"), (size * 4).alias("black"), (200 - size).alias("white"))
    return p.select("p_partkey", F.array_join(profiles.problems(p.columns), ";").alias("problems"))


@query("""WITH e AS (SELECT source, lang, doc_id, n_chars FROM documents), m AS (SELECT source, lang, max(n_chars) AS most FROM e GROUP BY ALL)
SELECT source, lang, min(doc_id) AS doc_id, any_value(most) AS n_chars FROM e JOIN m USING (source, lang) WHERE n_chars = most GROUP BY ALL""")
def argmax_first(spark, sf_dir):
    """The longest text of each source and language; of equal ones the first."""
    best = F.min_by(F.struct("doc_id", "n_chars"), F.struct(-F.col("n_chars"), F.col("doc_id")))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(best.alias("b")).select("source", "lang", "b.doc_id", "b.n_chars")


@query("""WITH r AS (SELECT source, doc_id, n_chars, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 1000000) - doc_id AS span FROM documents) SELECT source, doc_id, span FROM r""")
def entry_spans(spark, sf_dir):
    """How far each entry of a table of contents reaches: to the next one, the last to the end."""
    following = F.lead("doc_id", 1, 1000000).over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", (following - F.col("doc_id")).alias("span"))
