"""Links of catalogue feeds: kinds, hosts, templates, names of downloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The relations and media types of catalogue feeds.
STREAM_REL = "http://vaemendis.net/opds-pse/stream"
ACQUISITION = "http://opds-spec.org/acquisition"
IMAGE_RELS = ("http://opds-spec.org/image", "http://opds-spec.org/image/thumbnail", "http://opds-spec.org/cover", "http://opds-spec.org/cover/thumbnail", "http://opds-spec.org/thumbnail")
NAV_RELS = (
    "self", "start", "up", "next", "previous", "prev", "first", "last", "subsection", "collection", "alternate", "related", "search", "http://opds-spec.org/sort/new",
    "http://opds-spec.org/sort/popular", "http://opds-spec.org/facet", "http://opds-spec.org/crawlable", "http://opds-spec.org/shelf", "http://opds-spec.org/subscriptions",
)
JSON_TYPES = ("opds+json", "webpub+json", "divina+json", "audiobook+json", "opds-publication+json", "application/json")
SEARCH_VARIABLES = ("searchTerms", "query", "search")
ZIP_TYPES = ("application/vnd.comicbook+zip", "application/x-cbz", "application/zip", "application/x-zip-compressed")
EPUB_TYPE = "application/epub+zip"


def rels(rel: Column) -> Column:
    return F.split(F.trim(F.coalesce(rel, F.lit(""))), r"\s+")


def is_acquisition(rel: Column) -> Column:
    return F.exists(rels(rel), lambda r: r.startswith(ACQUISITION))


def is_search_template(href: Column) -> Column:
    """Any `{...}` names a search variable, whatever modifies it."""
    names = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(href, F.lit("")), F.lit(r"\{[?&]?([^{}]*)\}"), F.lit(1)), lambda e: F.split(e, ",")))
    return F.exists(names, lambda n: F.regexp_replace(F.trim(n), r"\*?(:.*)?\??$", "").isin(*SEARCH_VARIABLES))


def unfilled(href: Column) -> Column:
    """Query expressions that nothing fills go."""
    return F.regexp_replace(href, r"\{[?&][^{}]*\}", "")


def classify(rel: Column, mime: Column, href: Column) -> Column:
    """What a link leads to, by the first rule that holds: p page stream, img, osd search description, dl download, s search, f feed."""
    rel, mime, href = rels(rel), F.lower(F.coalesce(mime, F.lit(""))), F.coalesce(href, F.lit(""))
    among = lambda names: F.arrays_overlap(rel, F.array(*map(F.lit, names)))
    feed = mime.contains("atom+xml")
    for t in JSON_TYPES:
        feed |= mime.contains(t)
    return (
        F.when(F.array_contains(rel, STREAM_REL) | href.contains("{pageNumber}"), "p").when(among(IMAGE_RELS), "img").when(mime.contains("opensearchdescription"), "osd")
        .when(F.exists(rel, lambda r: r.startswith(ACQUISITION)), "dl").when(is_search_template(href), "s").when(feed, "f").when(mime.startswith("image/"), "img").when(among(NAV_RELS), "f").otherwise("dl")
    )


def host_key(url: Column) -> Column:
    """The lower-case host, with its port unless that is the scheme's own; empty where there is none."""
    scheme, port = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return F.when(usual, host).otherwise(F.concat(host, F.lit(":"), port))


def is_fetchable(url: Column) -> Column:
    """http or https, a host, no port 0, no control characters."""
    whole = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0)
    return F.coalesce(whole & ~url.rlike(r"[\x00-\x1f\x7f]") & ~F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")).rlike(r":0+$"), F.lit(False))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def probably_zip(url: Column, header: Column) -> Column:
    return F.lower(url).rlike(r"\.(cbz|zip)$") | media_type(header).isin(*ZIP_TYPES)


def is_comic_zip(content: Column, header: Column) -> Column:
    """A ZIP by its first bytes that isn't an EPUB, by type or by its first entry."""
    bytes_at = lambda at, n: F.substring(content, at + 1, n)
    epub = (media_type(header) == EPUB_TYPE) | ((bytes_at(30, 8) == F.lit(b"mimetype")) & (bytes_at(38, 20) == F.lit(EPUB_TYPE.encode())))
    return ~epub & bytes_at(0, 4).isin(b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")


def suffix_of(content: Column, name: Column) -> Column:
    """By the first bytes, or else that of the name."""
    at = lambda i, n: F.substring(content, i + 1, n)
    return (
        F.when(at(0, 3) == F.lit(b"\xff\xd8\xff"), ".jpg").when(at(0, 4) == F.lit(b"\x89PNG"), ".png")
        .when((at(0, 4) == F.lit(b"RIFF")) & (at(8, 4) == F.lit(b"WEBP")), ".webp").otherwise(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    )


def page_count(raw: Column) -> Column:
    """Up to nine decimal digits, else 0."""
    return F.when(F.trim(raw).rlike(r"^[0-9]{1,9}$"), F.trim(raw).cast("int")).otherwise(0)


def part_href(href: Column, part: Column, parts: Column) -> Column:
    return F.concat(href, F.when(href.contains("?"), "&").otherwise("?"), F.lit("part="), part, F.lit("&parts="), parts)


def valid_part(part: Column, parts: Column) -> Column:
    """1 <= part <= parts <= 99, both decimal; one part is the whole."""
    number = lambda c: F.when(c.rlike(r"^[0-9]{1,4}$"), c.cast("int"))
    return F.coalesce((number(part) >= 1) & (number(part) <= number(parts)) & number(parts).between(2, 99), F.lit(False))


def upstream_status(status: Column) -> Column:
    return F.when((status >= 500) | (status == 407), 502).otherwise(status)


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-fA-F]{32}$"), F.lit(False))
