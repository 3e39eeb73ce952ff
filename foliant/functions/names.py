"""Names, numbers and headers of requests and downloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.addresses import percent
from foliant.functions.binding import let
from foliant.functions.links import probably_zip

# The response headers that are passed on, and those of them that a changed body takes away.
FORWARDED = ("content-type", "content-disposition", "last-modified", "etag")
VALIDATORS = ("etag", "last-modified", "content-type")
MOST_PARTS, LONG_BOOK, TRAIL_STEPS, TRAIL_NAME = 99, 200, 8, 60
KINDLE_PREFIX = "kindle-"
PROGRESS_BYTES = 1024


def query_int(raw: Column) -> Column:
    """A whole number of a query, negative ones and anything else as 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.when(F.trim(raw).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(raw).cast("long")), F.lit(0).cast("long")))


def variant_int(node: Column) -> Column:
    """A JSON number or decimal text as a number; null for anything else, true and false too."""
    kind = F.schema_of_variant(node)
    text = F.try_variant_get(node, "$", "string")
    return F.when(kind.isin("BIGINT") | ((kind == "STRING") & text.rlike("^[0-9]{1,18}$")), text.cast("long"))


def file_name(header: Column, url: Column) -> Column:
    """The name of a download: of the content-disposition (the encoded form first), else the last part of the path, else `download`."""
    star = F.regexp_extract(header, r"(?i)filename\*\s*=\s*[\w-]*'[^']*'([^;]+)", 1)
    plain = F.coalesce(F.nullif(F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(header, r'(?i)filename\s*=\s*([^";\s]+)', 1))
    said = F.when(star != "", F.try_url_decode(F.replace(F.trim(star), F.lit("+"), F.lit("%2B")))).otherwise(F.nullif(plain, F.lit("")))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.try_url_decode(F.replace(F.regexp_extract(path, "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.coalesce(said, F.nullif(last, F.lit("")), F.lit("download"))


def attachment(name: Column) -> Column:
    """A content-disposition; where the name is more than plain ASCII, with its encoded form."""
    plain = F.regexp_replace(name, r'[^ -~]|["\\]', "_")
    short = F.concat(F.lit('attachment; filename="'), plain, F.lit('"'))
    return F.when(plain == name, short).otherwise(F.concat(short, F.lit("; filename*=UTF-8''"), percent(name)))


def part_name(name: Column, part: Column, parts: Column) -> Column:
    """The name of a part's file: the number goes before the suffix, if there is one after a stem."""
    label = F.concat(F.lit(" ("), part.cast("string"), F.lit(" of "), parts.cast("string"), F.lit(")"))
    stem, suffix = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1), F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)
    return F.when(parts.isNull(), name).when(stem == "", F.concat(name, label)).otherwise(F.concat(stem, label, F.lit("."), suffix))


def kindle_title(name: Column) -> Column:
    """The title of a download's name: without the suffix of a comic archive."""
    return F.regexp_replace(name, r"(?si)^(.+)\.(cbz|zip)$", "$1")


def archive_link(mime: Column, url: Column) -> Column:
    """A link to a comic archive: one that tells no type, or that is probably a ZIP."""
    return (F.coalesce(F.trim(mime), F.lit("")) == "") | probably_zip(url, F.coalesce(mime, F.lit("")))


def series_and_volume(url: Column) -> Column:
    """struct<series, volume> of the numbers in a path .../series/<n>[/volume/<m>]...; nulls where it has none."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    found = lambda g: F.nullif(F.regexp_extract(path, r"(?i)/series/(\d+)(?:/volume/(\d+))?", g), F.lit("")).cast("long")
    return F.struct(found(1).alias("series"), found(2).alias("volume"))


def credential_key(headers: Column) -> Column:
    """What tells one caller's answers from another's: the credentials among a map of headers (names in lower case), in order, as a digest."""
    own = F.array_sort(F.map_entries(F.map_filter(headers, lambda k, v: k.isin("authorization", "cookie", "x-api-key"))))
    return F.sha2(F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n"), 256)


def passed_headers(headers: Column, changed: bool = False) -> Column:
    """Of a map of headers (names in lower case) those that are passed on; of a changed body not what told of the old one."""
    gone = VALIDATORS if changed else ()
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*[h for h in FORWARDED if h not in gone]))


def told_status(status: Column, challenge: Column) -> Column:
    """struct<status, challenge>: failures of the source are 502; a 401 keeps its challenge."""
    return F.struct(F.when((status >= 500) | (status == 407), 502).otherwise(status).alias("status"), F.when(status == 401, challenge).alias("challenge"))


def job_id(value: Column) -> Column:
    """1 to 64 letters, digits and `-`, or null."""
    return F.when(value.rlike(r"^[A-Za-z0-9-]{1,64}\z"), value)


def rest_id(value: Column) -> Column:
    """1 to 64 letters, digits, `_` and `-`, or null."""
    return F.when(value.rlike(r"^[A-Za-z0-9_-]{1,64}\z"), value)


def progress_body(raw: Column) -> Column:
    """struct<page, completed> of a report, or null: a JSON object of at most 1024 bytes of these two alone, the page a number from 1, completed true or false."""
    node = F.try_parse_json(F.when(F.octet_length(raw) <= PROGRESS_BYTES, raw))
    keys = F.json_object_keys(F.to_json(node))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    page = F.try_variant_get(node, "$.page", "long")
    fine = (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(F.lit("page"), F.lit("completed")))) == 0)
    fine &= ~F.array_contains(keys, "page") | ((kind("$.page") == "BIGINT") & (page >= 1))
    fine &= ~F.array_contains(keys, "completed") | (kind("$.completed") == "BOOLEAN")
    return F.when(fine, F.struct(page.alias("page"), F.try_variant_get(node, "$.completed", "boolean").alias("completed")))


def book_parts(count: Column, estimate: Column) -> Column:
    """Parts of an entry: its estimate, if it has 200 pages or more, of at least 2 and at most 99; else 1."""
    return F.when((count >= LONG_BOOK) & (estimate > 1), F.least(F.lit(MOST_PARTS), estimate)).otherwise(1).cast("int")


def trail_token(rows: Column) -> Column:
    """A breadcrumb trail, array<struct<token, name>>, as one token: the last 8 rows, names cut to 60 characters."""
    flat = lambda text: F.trim(F.regexp_replace(text, r"\s+", " "))
    last = F.slice(rows, F.greatest(F.lit(1), F.size(rows) - TRAIL_STEPS + 1), F.lit(TRAIL_STEPS))
    text = F.array_join(F.transform(last, lambda r: F.concat(r["token"], F.lit("\t"), F.substring(flat(r["name"]), 1, TRAIL_NAME))), "\n")
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def trail_rows(token: Column) -> Column:
    """The trail of trail_token()."""
    padded = F.concat(F.translate(token, "-_", "+/"), F.expr("repeat('=', 3)").substr(F.lit(1), (4 - F.length(token) % 4) % 4))
    lines = F.filter(F.slice(F.split(F.decode(F.unbase64(padded), "UTF-8"), "\n"), 1, TRAIL_STEPS), lambda r: r.rlike("^[A-Za-z0-9_-]+(\t|$)"))
    return F.transform(lines, lambda r: F.struct(F.split_part(r, F.lit("\t"), F.lit(1)).alias("token"), F.split_part(r, F.lit("\t"), F.lit(2)).alias("name")))


def kindle_profile(name: Column, fmt: Column, reslice: Column) -> Column:
    """The format that a Kindle book of a profile gets, or null: named kindle..., not raw, not re-cut; WebP pages become palette PNGs."""
    return F.when(name.startswith(KINDLE_PREFIX) & (fmt != "raw") & ~reslice, F.when(fmt == "webpc", "pngc").otherwise(fmt))


def uuid5(name: Column, space: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The name-based (SHA-1) UUID of a text; `space`: that of addresses."""
    raw = F.sha1(F.concat(F.lit(bytes.fromhex(space)), F.encode(name, "UTF-8")))

    def written(h: Column) -> Column:
        variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return let(raw, written)
