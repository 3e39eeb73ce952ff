"""Feeds, search descriptions, manifests and book metadata as documents: parsed into columns, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.links import classify, is_search_template, rels

# Relations of covers, best first; the order of the tags of ComicInfo; its marks of right-to-left books.
COVER_RELS = ("http://opds-spec.org/image", "http://opds-spec.org/cover", "http://opds-spec.org/image/thumbnail", "http://opds-spec.org/cover/thumbnail", "http://opds-spec.org/thumbnail")
COMIC_TAGS = (
    "Title", "Series", "Number", "Count", "Volume", "AlternateSeries", "AlternateNumber", "AlternateCount", "Summary", "Notes", "Year", "Month", "Day", "Writer", "Penciller", "Inker", "Colorist", "Letterer",
    "CoverArtist", "Editor", "Publisher", "Imprint", "Genre", "Web", "PageCount", "LanguageISO", "Format", "BlackAndWhite", "Manga", "Characters", "Teams", "Locations", "ScanInformation", "StoryArc", "SeriesGroup", "AgeRating",
)
RIGHT_TO_LEFT = ("yes", "yesandrighttoleft")
COMIC_BYTES, MOST_AUTHORS = 4 << 20, 20

_LINK = "array<struct<_rel: string, _type: string, _href: string, _length: long, _count: string>>"
FEED = f"title string, link {_LINK}, entry array<struct<title: string, id: string, summary: string, link: {_LINK}>>"


def parse_feed(xml: Column) -> Column:
    """An Atom feed as a struct of FEED; null where the text is no XML."""
    return F.from_xml(xml, FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})


def first_link(links: Column, kind: str) -> Column:
    """The first link of `kind` that has an address."""
    found = F.filter(links, lambda k: (F.coalesce(k["_href"], F.lit("")) != "") & (classify(k["_rel"], k["_type"], k["_href"]) == kind))
    return F.try_element_at(found, F.lit(1))


def cover_of(links: Column) -> Column:
    """The address of the first link with the best of COVER_RELS."""
    of = lambda rel: F.try_element_at(F.filter(links, lambda k: F.array_contains(rels(k["_rel"]), rel) & (F.coalesce(k["_href"], F.lit("")) != "")), F.lit(1))["_href"]
    return F.coalesce(*[of(rel) for rel in COVER_RELS])


def browse(feeds: DataFrame, xml: str) -> DataFrame:
    """A row for each entry of the feeds that leads somewhere: `position`, `title`, `href`, `cover`, `download`.

    The first download wins over the first feed. An entry without a title is Untitled; one that leads nowhere gives no
    row, nor does a feed that can't be read.
    """
    entries = feeds.select(*[c for c in feeds.columns if c != xml], F.posexplode(parse_feed(F.col(xml))["entry"]).alias("position", "_entry"))
    links = F.col("_entry.link")
    found = entries.withColumn("_dl", first_link(links, "dl")).withColumn("_to", F.coalesce("_dl", first_link(links, "f"))).where("_to is not null")
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("_entry.title", r"\s+", " ")), F.lit("")), F.lit("Untitled"))
    return found.withColumns({"title": title, "href": F.col("_to._href"), "cover": cover_of(links), "download": F.col("_dl").isNotNull()}).drop("_entry", "_dl", "_to")


def search_template(xml: Column) -> Column:
    """The first template of an OpenSearch description that takes a search term, or null."""
    urls = F.from_xml(xml, "Url array<struct<_template: string>>", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})["Url"]
    return F.try_element_at(F.filter(F.transform(urls, lambda u: u["_template"]), is_search_template), F.lit(1))


def comic_info(xml: Column) -> Column:
    """struct<authors, right_to_left> of a ComicInfo text: distinct writers (else pencillers) in order; nothing of what can't be read."""
    fields = F.from_xml(F.when(F.octet_length(xml) <= COMIC_BYTES, xml), "Writer string, Penciller string, Manga string", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    said = lambda tag: F.nullif(F.trim(fields[tag]), F.lit(""))
    names = F.transform(F.split(F.coalesce(said("Writer"), said("Penciller"), F.lit("")), ","), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    authors = F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, MOST_AUTHORS)
    return F.struct(authors.alias("authors"), F.coalesce(F.lower(F.trim(fields["Manga"])).isin(*RIGHT_TO_LEFT), F.lit(False)).alias("right_to_left"))


def xml_text(value: Column) -> Column:
    """`value` as the text of an element."""
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def comic_xml(fields: dict[str, Column], sizes: Column) -> Column:
    """A ComicInfo text: `fields` in the order of COMIC_TAGS, null ones left out, then a page for each of `sizes` (struct<width, height>, null: unknown)."""
    tags = [F.concat(F.lit(f"  <{t}>"), xml_text(fields[t].cast("string")), F.lit(f"</{t}>\n")) for t in COMIC_TAGS if t in fields]

    def page(size: Column, i: Column) -> Column:
        known = F.when(size["width"].isNotNull(), F.concat(F.lit(' ImageWidth="'), size["width"], F.lit('" ImageHeight="'), size["height"], F.lit('"')))
        return F.concat(F.lit('    <Page Image="'), i, F.lit('"'), F.when(i == 0, ' Type="FrontCover"').otherwise(""), F.coalesce(known, F.lit("")), F.lit(" />\n"))

    head = '<?xml version="1.0" encoding="utf-8"?>\n<ComicInfo xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:xsd="http://www.w3.org/2001/XMLSchema">\n'
    return F.concat(F.lit(head), *[F.coalesce(t, F.lit("")) for t in tags], F.lit("  <Pages>\n"), F.array_join(F.transform(sizes, page), ""), F.lit("  </Pages>\n</ComicInfo>\n"))


def rel_text(node: Column) -> Column:
    """The `rel` of a JSON link, which may be a text or a list, as one text."""
    return F.coalesce(F.array_join(F.try_variant_get(node, "$.rel", "array<string>"), " "), F.try_variant_get(node, "$.rel", "string"), F.lit(""))


def manifest_links(manifests: DataFrame, json: str) -> DataFrame:
    """A row for each link of JSON manifests: `title`, `pages`, `container` (links, images, readingOrder, resources), `position`, `rel`, `kind`, `href`, `cover`.

    Images are images whatever they say. The cover is the first image's address. Unreadable texts give no row.
    """
    own = [c for c in manifests.columns if c != json]
    v = manifests.withColumn("_v", F.try_parse_json(json)).select(*own, "_v", F.try_variant_get("_v", "$.metadata.title", "string").alias("title"), F.coalesce(F.try_variant_get("_v", "$.metadata.numberOfPages", "long"), F.lit(0)).alias("pages"), F.try_variant_get("_v", "$.images[0].href", "string").alias("cover"))

    def listed(container: str) -> Column:
        nodes = F.coalesce(F.try_variant_get("_v", f"$.{container}", "array<variant>"), F.expr("array()"))
        return F.transform(nodes, lambda n, i: F.struct(F.lit(container).alias("container"), i.alias("position"), rel_text(n).alias("rel"), F.try_variant_get(n, "$.type", "string").alias("type"), F.try_variant_get(n, "$.href", "string").alias("href")))

    each = F.flatten(F.array(*[listed(c) for c in ("links", "images", "readingOrder", "resources")]))
    rows = v.select(*own, "title", "pages", "cover", F.inline(each)).where("href is not null")
    return rows.withColumn("kind", F.when(F.col("container") == "images", "img").otherwise(classify(F.col("rel"), F.coalesce("type", F.lit("")), F.col("href")))).drop("type")


def trail(steps: Column, most: int = 8) -> Column:
    """A breadcrumb trail: a step that is on the trail already cuts it back to there; the last `most` stay. `steps` is one visit's."""

    def walk(seen: Column, step: Column) -> Column:
        at = F.array_position(seen, step).cast("int")
        return F.when(at > 0, F.slice(seen, F.lit(1), at)).otherwise(F.concat(seen, F.array(step)))

    whole = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.slice(whole, F.greatest(F.lit(1), F.size(whole) - most + 1), F.lit(most))
