"""Addresses in catalogues: resolved, sealed into tokens, expanded, and mapped to this server's own paths."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.binding import let
from foliant.functions.links import SEARCH_VARIABLES, host_key, is_fetchable, unfilled
from foliant.functions.strings import decode_token, encode_token

# What stands for the key in a token, where it may stand, the mirrored layouts, and the parameters that this server adds.
SEAL = "~key~"
KEY_PLACES = r"(?i)((?<=/api/opds/)~key~(?=[/?#]|$)|(?<=[?&]apikey=)~key~(?=[&#]|$))"
SERIES_MIRROR, BOOK_MIRROR = "/api/opds/key/image", "/opds/v1.2"
PAGE_PAIR, ADDED = "pageNumber={pageNumber}", ("maxWidth", "count")
PATH_SAFE = "/!$&'()*+,;=:@"


@dataclass(frozen=True)
class Context:
    """Where a feed comes from and goes to: the profile, this server, the key to seal, and the roots of the two mirrored layouts (empty: none)."""

    profile: str
    public: str
    secret: str = ""
    series_root: str = ""
    book_root: str = ""

    @property
    def prefix(self) -> str:
        return f"{self.public}/{quote(self.profile)}"


def percent(text: Column) -> Column:
    """Percent-encoded, all but letters, digits and `_.-~`."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_dots(path: Column) -> Column:
    """A path without `.` and `..`; what would climb over the root stays there."""
    parts = F.split(path, "/")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.filter(parts, lambda s, i: (i > 0) | (s != "")), F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.concat(kept, end), "/"))


def resolve(base: Column, href: Column) -> Column:
    """`href` as seen from `base`, an absolute address."""

    def seen(own: Column, rest: Column, href: Column) -> Column:
        root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
        path, search = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"^[^#?]*(\?[^#]*)", 1)
        folder = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, r"[^/]*$", ""), own), "/{2,}", "/")
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
            .when(href.startswith("/"), F.concat(root, without_dots(own), rest))
            .when(own != "", F.concat(root, let(folder, without_dots), rest))
            .when(rest.startswith("?"), F.concat(root, path, rest))
            .otherwise(F.concat(root, path, search, rest))
        )

    return let(href, lambda h: let(F.regexp_extract(h, r"^([^?#]*)", 1), lambda own: seen(own, F.regexp_extract(h, r"^[^?#]*(.*)$", 1), h)))


def sealed_token(url: Column, cover: Column | None = None, secret: str = "") -> Column:
    """A token of an address and, on a second line, that of its cover; the key is sealed."""
    text = url if cover is None else F.when(F.coalesce(cover, F.lit("")) != "", F.concat(url, F.lit("\n"), cover)).otherwise(url)
    return encode_token(F.replace(text, F.lit(secret), F.lit(SEAL)) if secret else text)


def unsealed(url: Column, secret: str) -> Column:
    """The key put back where it may stand; null where a seal stands elsewhere."""
    if not secret:
        return url
    head = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    tail = F.regexp_replace(F.substr(url, F.length(head) + 1), F.lit(KEY_PLACES), F.lit(secret.replace("\\", "\\\\").replace("$", "\\$")))
    out = F.concat(head, tail)
    return F.when(~url.contains(SEAL), url).when((head != "") & ~out.contains(SEAL), out)


def opened_token(token: Column, secret: str = "") -> Column:
    """struct<url, cover> of a token; a null url if it is malformed, a null cover if that can't be fetched."""
    legal = F.when(token.rlike("^[A-Za-z0-9_-]+$") & (F.length(token) % 4 != 1), token)
    text = F.split(decode_token(legal), "\n", 2)
    url, cover = unsealed(F.get(text, F.lit(0)), secret), unsealed(F.get(text, F.lit(1)), secret)
    good = is_fetchable(url)
    return F.struct(F.when(good, url).alias("url"), F.when(good & is_fetchable(cover), cover).alias("cover"))


def fill_search(template: Column, term: Column) -> Column:
    """A search template with its term: `{name}`, `{?a,b}`, `{&a}`, with `:n` for the first n characters and `*` ignored.

    Query expressions that name nothing to search for go; other expressions stay, unless they are optional.
    """
    bare = lambda n: F.regexp_replace(F.regexp_replace(n, r"\?$", ""), r"(\*?)(:.*)?$", "")

    def value(name: Column) -> Column:
        size = F.regexp_extract(name, r":([0-9]{1,5})\??$", 1)
        most = F.when(size != "", size.cast("int")).otherwise(0)
        return percent(F.when(most.between(1, 9999), F.substr(term, F.lit(1), most)).otherwise(term))

    def expand(part: Column) -> Column:
        op, spec = F.regexp_extract(part, r"^\{([?&]?)", 1), F.regexp_extract(part, r"^\{[?&]?([^{}]*)\}", 1)
        names = F.filter(F.transform(F.split(spec, ","), lambda n: F.trim(n)), lambda n: bare(n).isin(*SEARCH_VARIABLES))
        pairs = F.array_join(F.transform(names, lambda n: F.concat(bare(n), F.lit("="), value(n))), "&")
        plain = F.when(F.size(names) > 0, F.array_join(F.transform(names, value), ",")).when(F.rtrim(spec).endswith("?"), "").otherwise(part)
        filled = F.when(op == "", plain).when(F.size(names) > 0, F.concat(op, pairs)).otherwise("")
        return F.when(part.rlike(r"^\{[?&]?[^{}]*\}$"), filled).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(r"(\{[?&]?[^{}]*\}|[^{]+|\{)"), F.lit(1)), expand), "")


def _names(search: Column) -> Column:
    return F.transform(F.split(search, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))


def series_mirror(url: Column, root: str) -> Column:
    """The mirrored path of a page stream under `root`/image that names its page once, and nothing that this server adds; else null."""
    if not root:
        return F.lit(None).cast("string")
    path, search = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    home, names = F.regexp_extract(F.lit(root), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), _names(search)
    braces = lambda c: F.regexp_count(search, F.lit(c))
    once = F.array_contains(F.split(search, "&"), PAGE_PAIR) & (F.size(F.filter(names, lambda n: n == "pageNumber")) == 1) & (braces(r"\{") == 1) & (braces(r"\}") == 1)
    ok = (path == F.concat(home, F.lit("/image"))) & (host_key(F.regexp_replace(url, r"[{}]", "")) == host_key(F.lit(root))) & once & ~F.arrays_overlap(names, F.array(*map(F.lit, ADDED)))
    return F.when(ok, F.concat(F.lit(f"{SERIES_MIRROR}?"), search))


def _under(url: Column, root: str) -> tuple[Column, Column, Column]:
    """(is under the root, the path beneath it, the query)."""
    plain = F.regexp_replace(url, r"[{}]", "")
    path, search = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    home = F.concat(F.regexp_extract(F.lit(root), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    same = (F.lower(F.regexp_extract(url, "^([^:]+):", 1)) == F.lower(F.regexp_extract(F.lit(root), "^([^:]+):", 1))) & (host_key(plain) == host_key(F.lit(root)))
    return same & F.startswith(path, home) & ~url.contains("#") & ~search.rlike(r"[{}]"), F.substr(path, F.length(home) + 1), search


def servable(rest: Column) -> Column:
    """No step of the path is `.`, `..` or a file, whatever follows a semicolon in it."""
    return ~F.exists(F.split(rest, "/"), lambda s: F.split_part(s, F.lit(";"), F.lit(1)).isin(".", "..", "file"))


def refused_path(rest: Column) -> Column:
    """Paths of the series mirror that would leave it or download: a step is `.`, `..` or `download`."""
    return F.exists(F.split(rest, "/"), lambda s: F.lower(s).isin(".", "..", "download"))


def book_feed_mirror(url: Column, root: str) -> Column:
    """The mirrored path of a feed under `root`, if its path is encoded as this server would and can be served; else null."""
    if not root:
        return F.lit(None).cast("string")
    here, rest, search = _under(url, root)
    exact = rest.rlike(r"^([A-Za-z0-9_.~/!$&'()*+,;=:@-]|%[0-9A-F]{2})+$") & ~rest.rlike(r"%(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2F|21|24|2[6-9]|2[ABC]|3[ABD]|40)")
    return F.when(here & exact & servable(rest), F.concat(F.lit(f"{BOOK_MIRROR}/"), rest, F.when(search != "", F.concat(F.lit("?"), search)).otherwise("")))


def book_stream_mirror(url: Column, root: str) -> Column:
    """The mirrored path of a page stream `books/<id>/pages/{pageNumber}` under `root`; else null."""
    if not root:
        return F.lit(None).cast("string")
    here, rest, search = _under(url, root)
    ok = here & rest.rlike(r"^books/[A-Za-z0-9_-]{1,64}/pages/\{pageNumber\}$") & ~F.arrays_overlap(_names(search), F.array(*map(F.lit, ADDED)))
    return F.when(ok, F.concat(F.lit(f"{BOOK_MIRROR}/"), rest, F.when(search != "", F.concat(F.lit("?"), search)).otherwise("")))


def unmirrored(search: Column, root: str) -> Column:
    """struct<url, page> of a mirrored stream's query; nulls unless it names its page once."""
    pairs = F.split(search, "&")
    page = F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == "pageNumber")
    kept = F.filter(F.transform(pairs, lambda p: F.when(F.split_part(p, F.lit("="), F.lit(1)) == "pageNumber", PAGE_PAIR).otherwise(p)), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin(*ADDED))
    ok = F.size(page) == 1
    return F.struct(F.when(ok, F.concat(F.lit(f"{root}/image?"), F.array_join(kept, "&"))).alias("url"), F.when(ok, F.regexp_extract(F.get(page, F.lit(0)), "=(.*)$", 1)).alias("page"))


def map_href(href: Column, kind: Column, base: Column, to: Context, cover: Column | None = None, count: Column | None = None, style: str = "opensearch") -> Column:
    """Where a link of `kind` leads on this server: page streams keep `{pageNumber}`, searches their term, other schemes their address.

    `style`: opensearch or opds2, which differ in what a search's term is called. Downloads carry their cover in the token.
    """
    term = "?query={query}" if style == "opds2" else "?q={searchTerms}"
    pages = F.lit("") if count is None else F.when(count > 0, F.concat(F.lit("&count="), count.cast("string"))).otherwise("")
    jacket = F.lit(None).cast("string") if cover is None else F.when((kind == "dl") & (F.coalesce(cover, F.lit("")) != ""), resolve(base, cover))

    def streamed(stream: Column) -> Column:
        return F.concat(F.lit(to.prefix), stream, F.when(stream.contains("?"), "&").otherwise("?"), F.lit("maxWidth={maxWidth}"), pages)

    def mapped(kind: Column, target: Column, token: Column) -> Column:
        stream = F.coalesce(series_mirror(target, to.series_root), book_stream_mirror(target, to.book_root), F.concat(F.lit("/p/"), token, F.lit("?page={pageNumber}")))
        out = F.when(kind == "p", let(stream, streamed))
        if to.book_root:
            out = out.when((kind == "f") & book_feed_mirror(target, to.book_root).isNotNull(), F.concat(F.lit(to.prefix), book_feed_mirror(target, to.book_root)))
        return out.when(kind == "s", F.concat(F.lit(f"{to.prefix}/s/"), token, F.lit(term))).otherwise(F.concat(F.lit(f"{to.prefix}/"), kind, F.lit("/"), token))

    def cleaned(clean: Column, kind: Column) -> Column:
        scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        own = let(resolve(base, clean), lambda target: let(sealed_token(target, jacket, to.secret), lambda token: mapped(kind, target, token)))
        return F.when(F.coalesce(clean, F.lit("")) == "", clean).when(~scheme.isin("", "http", "https"), clean).otherwise(own)

    return let(kind, lambda k: let(F.when(k.isin("p", "s", "bs"), href).otherwise(unfilled(href)), lambda clean: cleaned(clean, k)))
