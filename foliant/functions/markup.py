"""Markup taken apart into arrays and put together again, so that columns can decide what becomes of its parts. Nothing here knows what a feed is but which tags are wanted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name spaces whose tags are told apart from others'.
SPACES = ("http://www.w3.org/2005/Atom", "http://a9.com/-/spec/opensearch/1.1/")
_ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}

_TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^<>\[]*(?:\[[^\]]*\][^<>]*)?>|</?[A-Za-z_:][^<>"'\s/]*(?:"[^"]*"|'[^']*'|[^<>"'])*>|[^<]+|<""", re.S)
_TAG = re.compile(r"<(/?)(?:([^\s/>:]+):)?([^\s/>:]+)")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*=\s*("[^"]*"|'[^']*')""")
_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|quot|apos|lt|gt|amp);")

PIECES = "array<struct<entry:boolean,tags:array<struct<raw:string,name:string,inside:string,rel:string,type:string,href:string,count:string,head:string,tail:string>>>>"


def unescaped(value: str) -> str:
    """References to characters resolved; those to none stay."""

    def sign(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return _ENTITIES[name]
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(sign, value)


def tags_of(text: str) -> Iterator[tuple[bool, dict]]:
    """(within an entry, tag) of all tags and texts; their `raw` joined is the text again. A tag has a name if it is of SPACES, or of none in a text that declares none for it.

    Comments, CDATA and what isn't closed are texts. The value of `href` (of a Url: of `template`) lies between head and tail.
    """
    open_tags: list[tuple[str, str | None, dict]] = []
    entry = 0
    for token in _TOKEN.findall(text):
        tag = {"raw": token, "name": None, "inside": None}
        m = _TAG.match(token) if token.endswith(">") and not token.startswith(("<!", "<?")) else None
        if m is None:
            tag["inside"] = open_tags[-1][1] if open_tags and not token.startswith("<") else None
            yield entry > 0, tag
            continue
        full = f"{m[2]}:{m[3]}" if m[2] else m[3]
        if m[1]:
            held = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == full), None)
            yield entry > 0, tag
            if held is not None:
                entry -= sum(name == "entry" for _, name, _ in open_tags[held:])
                del open_tags[held:]
            continue
        spaces = open_tags[-1][2] if open_tags else {}
        attributes = [(a.group(1), a) for a in _ATTRIBUTE.finditer(token, m.end())]
        declared = {n.partition(":")[2]: unescaped(a.group(2)[1:-1]) for n, a in attributes if n == "xmlns" or n.startswith("xmlns:")}
        spaces = spaces | declared if declared else spaces
        space = spaces.get(m[2] or "")
        described = m[3] in ("OpenSearchDescription", "Url") and (not open_tags or open_tags[0][1] == "OpenSearchDescription")
        name = m[3] if space in SPACES or described or (space is None and m[2] in (None, "", "atom")) else None
        tag["name"] = name
        if name in ("link", "Url"):
            wanted = "href" if name == "link" else "template"
            for n, a in attributes:
                value = unescaped(a.group(2)[1:-1])
                if n == wanted and "head" not in tag:
                    tag |= {"href": value, "head": token[: a.start(2)], "tail": token[a.end(2) :]}
                elif n in ("rel", "type") or n.rpartition(":")[2] == "count":
                    tag[n.rpartition(":")[2]] = value
        entry += name == "entry"
        yield entry > 0, tag
        if token.endswith("/>"):
            entry -= name == "entry"
        else:
            open_tags.append((full, name, spaces))


def _pieces(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    out: list[dict] = []
    for entry, tag in tags_of(text):
        begins = tag["name"] == "entry"
        if not out or out[-1]["entry"] != entry or begins:
            out.append({"entry": entry, "tags": []})
        out[-1]["tags"].append(tag)
    return out


def xml_pieces(text: Column) -> Column:
    """A text's tags and texts (PIECES), each entry's by themselves."""

    def taken_apart(texts: pd.Series) -> pd.Series:
        return texts.map(_pieces)

    return F.pandas_udf(taken_apart, PIECES)(text)


# --- JSON by pointers --------------------------------------------------------------------------------------------------------------------------------------

OBJECTS = "array<struct<path:string,fields:map<string,string>>>"
#: Fields that are told of an object.
FIELDS = ("href", "rel", "type", "title", "numberOfPages")


def _field(value) -> str | None:
    if isinstance(value, list):
        return " ".join(v for v in value if isinstance(v, str))
    return value if isinstance(value, str) else str(value) if type(value) is int else None


def _objects(text: str | None) -> list[dict] | None:
    try:
        doc = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None
    out, ahead = [], [("", doc)]
    while ahead:
        path, node = ahead.pop()
        if isinstance(node, dict):
            fields = {k: v for k in FIELDS if k in node and (v := _field(node[k])) is not None and (k == "rel" or not isinstance(node[k], list))}
            if fields:
                out.append({"path": path, "fields": fields})
            below = [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in node.items()]
        else:
            below = [(f"{path}/{i}", v) for i, v in enumerate(node)] if isinstance(node, list) else []
        ahead += [b for b in reversed(below) if isinstance(b[1], (dict, list))]
    return out


def json_objects(text: Column) -> Column:
    """Where a document's objects are (as JSON pointers) and their FIELDS (OBJECTS), in the document's order; null where it is no JSON."""

    def taken_apart(texts: pd.Series) -> pd.Series:
        return texts.map(_objects)

    return F.pandas_udf(taken_apart, OBJECTS)(text)


def _at(doc, path: str):
    """(what holds it, its key) of a pointer."""
    *way, last = (p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:])
    for p in way:
        doc = doc[int(p)] if isinstance(doc, list) else doc[p]
    return doc, int(last) if isinstance(doc, list) else last


def edited(text: str, edits: list, versions: list) -> str:
    """The document with values set (JSON, null: taken out) at pointers; then objects replaced by several, each with edits of its own. Pointers are those of the document as it was."""
    doc = json.loads(text)
    lists: dict[int, tuple[list, dict]] = {}

    def put(root, path: str, value: str | None) -> None:
        held, key = _at(root, path)
        if value is not None:
            held[key] = json.loads(value)
        elif isinstance(held, dict):
            held.pop(key, None)
        else:
            lists.setdefault(id(held), (held, {}))[1][key] = []

    for e in edits:
        put(doc, e["path"], e["value"])
    for v in sorted(versions, key=lambda v: -v["path"].count("/")):
        held, key = _at(doc, v["path"])
        plain = json.dumps(held[key])
        several = []
        for own in v["edits"]:
            several.append(json.loads(plain))
            for e in own:
                put(several[-1], e["path"], e["value"])
        lists.setdefault(id(held), (held, {}))[1][key] = several
    for held, by_place in lists.values():
        held[:] = [x for i, one in enumerate(held) for x in by_place.get(i, [one])]
    return json.dumps(doc, ensure_ascii=False)


def with_json_edits(df: DataFrame, text: str, edits: str, versions: str) -> DataFrame:
    """`df` with column `text` edited(), by columns of struct<path,value> and struct<path,edits> arrays, which go; null where `edits` is."""
    kept = [c for c in df.columns if c not in (edits, versions)]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b[text], b[edits], b[versions])
            yield b.assign(**{text: pd.Series([None if t is None or e is None else edited(t, list(e), list(v)) for t, e, v in rows], b.index, object)})[kept]

    return df.mapInPandas(put, df.select(kept).schema)
