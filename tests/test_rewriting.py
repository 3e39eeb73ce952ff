"""Feeds rewritten in place, addresses and tokens, against cases worked out by hand."""

import base64
import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from foliant.functions import addresses, rewriting
from foliant.functions.addresses import Context

BASE = "https://cat.org/opds/v1/list?x=1"
TO = Context("my page", "http://me:80", secret="k3y")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def whole(spark, text, *options, f=rewriting.rewrite, **more):
    return f(spark.createDataFrame([(text,)], "f string"), "f", F.lit(BASE), TO, *options, **more).first().f


def token(url, cover=None):
    return base64.urlsafe_b64encode((f"{url}\n{cover}" if cover else url).encode()).decode().rstrip("=")


@pytest.mark.parametrize("href", ["https://x.org/a", "//cdn.org/p?q", "/root/../r2/./x", "rel/7", "../up/7?z=1", "../../../far", "?q=7", "#part", "", "a//b", "./", "..", "mailto:me@x"])
def test_addresses_resolve(spark, href):
    assert one(spark, addresses.resolve(F.lit(BASE), F.col("h")), h=href) == urljoin(BASE, href)


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("/s?q={searchTerms}", "/s?q=two%20w%2Fords"), ("/s{?query}", "/s?query=two%20w%2Fords"), ("/s?a=1{&query,page}", "/s?a=1&query=two%20w%2Fords"), ("/s/{query:3}", "/s/two"), ("/s/{query*}", "/s/two%20w%2Fords"),
        ("/s/{lang?}/x", "/s//x"), ("/s/{other}", "/s/{other}"), ("/s{?other}", "/s"), ("/{a,search?}", "/two%20w%2Fords"), ("/x{y", "/x{y"),
    ],
)
def test_search_templates_are_filled(spark, template, want):
    assert one(spark, addresses.fill_search(F.col("t"), F.lit("two w/ords")), t=template) == want


def test_tokens_seal_the_key_and_open_again(spark):
    url, cover = "https://cat.org/api/opds/k3y/image?a=1&apikey=k3y", "https://cat.org/c.png"
    got = one(spark, addresses.sealed_token(F.col("u"), F.col("c"), "k3y"), u=url, c=cover)
    assert got == token(url.replace("k3y", "~key~"), cover)
    back = one(spark, addresses.opened_token(F.col("t"), "k3y"), t=got)
    assert (back.url, back.cover) == (url, cover)
    for bad in (token("ftp://x/y"), token("https://cat.org/other/~key~"), "a", "§", token("https://x.org/\x01")):
        assert one(spark, addresses.opened_token(F.col("t"), "k3y"), t=bad).url is None
    assert one(spark, addresses.opened_token(F.col("t"), "k3y"), t=token("https://x.org/a", "nonsense")) == ("https://x.org/a", None)


def test_mirrors(spark):
    root = "https://cat.org/api/opds/k3y"
    link = lambda u: one(spark, addresses.series_mirror(F.col("u"), root), u=u)
    assert link(f"{root}/image?chapterId=4&pageNumber={{pageNumber}}") == "/api/opds/key/image?chapterId=4&pageNumber={pageNumber}"
    assert [link(u) for u in (f"{root}/image?pageNumber=1", f"{root}/other?pageNumber={{pageNumber}}", f"{root}/image?count=3&pageNumber={{pageNumber}}", "https://else.org/api/opds/k3y/image?pageNumber={pageNumber}")] == [None] * 4
    got = one(spark, addresses.unmirrored(F.col("q"), root), q="chapterId=4&pageNumber=7&maxWidth=600")
    assert (got.url, got.page) == (f"{root}/image?chapterId=4&pageNumber={{pageNumber}}", "7")
    home = "https://k.org/opds/v1.2"
    feed = lambda u: one(spark, addresses.book_feed_mirror(F.col("u"), home), u=u)
    assert feed(f"{home}/series/1?p=2") == "/opds/v1.2/series/1?p=2"
    assert [feed(u) for u in (f"{home}/a/../b", f"{home}/x/file", f"{home}/a%41", "http://k.org/opds/v1.2/series", f"{home}/", f"{home}/a#b")] == [None] * 6
    assert one(spark, addresses.book_stream_mirror(F.col("u"), home), u=f"{home}/books/Ab1/pages/{{pageNumber}}?z=1") == "/opds/v1.2/books/Ab1/pages/{pageNumber}?z=1"


FEED = """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:pse="http://vaemendis.net/opds-pse/ns"><icon> /i.png </icon><title>T</title><link rel="self" href="/opds/self" type="application/atom+xml"/>
<entry><title>Big &amp; long</title><id>7</id><x:own a='b'>kept</x:own><link rel='http://opds-spec.org/image' href="c.png?a=1&amp;b=2" type="image/png"/>
<link rel="http://opds-spec.org/acquisition" href="/dl/7{?x}" type="application/zip"/><link rel="http://vaemendis.net/opds-pse/stream" href="/p/7/{pageNumber}" pse:count="250" type="image/jpeg"/></entry>
<entry><title>Small</title><id>8</id><link href="mailto:a@b" rel="x"/></entry></feed>"""


def test_an_atom_feed_is_rewritten_in_place(spark):
    parts = lambda href, pages: F.when(pages >= 200, 2).otherwise(1)
    got = whole(spark, FEED, "image/png", parts=parts)
    p = "http://me:80/my%20page"
    dl = f'href="{p}/dl/{token("https://cat.org/dl/7", "https://cat.org/opds/v1/c.png?a=1&b=2")}'
    assert f"<icon>{p}/img/{token('https://cat.org/i.png')}</icon>" in got and f'href="{p}/f/{token("https://cat.org/opds/self")}"' in got
    assert got.count("<entry>") == 3 and got.count("<x:own a='b'>kept</x:own>") == 2 and '<link href="mailto:a@b" rel="x"/>' in got
    assert all(f"<title>Big &amp; long ({k} of 2)</title><id>7 ({k} of 2)</id>" in got and f'{dl}?part={k}&amp;parts=2"' in got for k in (1, 2))
    assert got.count(f'href="{p}/p/{token("https://cat.org/p/7/{pageNumber}")}?page={{pageNumber}}&amp;maxWidth={{maxWidth}}&amp;count=250" pse:count="250" type="image/png"') == 2
    without = one(spark, rewriting.rewrite_atom(F.col("f"), F.lit(BASE), TO, stream=False), f=FEED)
    assert "pageNumber" not in without and without.count("<entry>") == 2


def test_a_search_description_is_rewritten(spark):
    text = '<?xml version="1.0"?><OpenSearchDescription xmlns="u"><Url type="a" template="/s?q={searchTerms}"/></OpenSearchDescription>'
    assert f'template="http://me:80/my%20page/s/{token("https://cat.org/s?q={searchTerms}")}?q={{searchTerms}}"' in whole(spark, text)


def test_a_json_feed_is_rewritten_at_any_depth(spark):
    acq = "http://opds-spec.org/acquisition"
    doc = {
        "links": [{"href": "/self", "rel": "self", "type": "application/opds+json"}, {"href": "/s{?query}", "rel": ["search"], "templated": True}],
        "groups": [{"publications": [{"metadata": {"title": "B", "numberOfPages": 300}, "images": [{"href": "/c.jpg", "type": "x"}], "links": [{"href": "/b.cbz", "rel": acq}], "deep": {"readingOrder": [{"href": "/1.jpg", "type": "image/jpeg", "width": 9}, {"href": "/2.txt"}]}}]}],
        "own": [1, None, "é"],
    }
    parts = lambda href, pages: F.when(pages >= 200, 2).otherwise(1)
    got = json.loads(whole(spark, json.dumps(doc), "image/png", parts=parts))
    p = "http://me:80/my%20page"
    assert got["links"] == [{"href": f"{p}/f/{token('https://cat.org/self')}", "rel": "self", "type": "application/opds+json"}, {"href": f"{p}/s/{token('https://cat.org/s{?query}')}?query={{query}}", "rel": ["search"], "templated": True}]
    books = got["groups"][0]["publications"]
    assert [b["metadata"]["title"] for b in books] == ["B (1 of 2)", "B (2 of 2)"] and got["own"] == doc["own"]
    assert books[1]["links"][0]["href"] == f"{p}/dl/{token('https://cat.org/b.cbz', 'https://cat.org/c.jpg')}?part=2&parts=2" and books[0]["images"][0]["href"] == f"{p}/img/{token('https://cat.org/c.jpg')}"
    assert books[0]["deep"]["readingOrder"] == [{"href": f"{p}/pf/{token('https://cat.org/1.jpg')}", "type": "image/png"}, {"href": f"{p}/dl/{token('https://cat.org/2.txt')}"}]
    no_stream = json.loads(whole(spark, json.dumps(doc), f=rewriting.rewrite_json, stream=False))
    assert [x["href"].split("/")[4] for x in no_stream["groups"][0]["publications"][0]["deep"]["readingOrder"]] == ["dl"]


def test_bodies_that_are_no_feeds(spark):
    assert whole(spark, "plain") == "plain"
    assert whole(spark, "{broken") == "{broken"
    assert whole(spark, "{broken k3y") is None
    for text, want in [("<feed/>", True), ("<?xml?><!-- c --> <a:entry>", True), ("<html>", False), ('{"href": 1}', True), ("[1]", False), ("", False)]:
        assert one(spark, rewriting.looks_like_feed(F.col("f")), f=text) is want
    wide = spark.createDataFrame([(b"\xff\xfe" + "<feed/>é".encode("utf-16-le"),), (b"\x00\x00\xfe\xff" + "ab".encode("utf-32-be"),), (b"plain \xff",)], "b binary")
    assert [r.x for r in wide.select(rewriting.narrow(F.col("b")).alias("x")).collect()] == ["<feed/>é", "ab", "plain �"]
    assert one(spark, rewriting.signed_by(F.col("f")), f="<feed><author><name>Komga</name></author></feed>") is True


ATOM = "http://www.w3.org/2005/Atom"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'<a:feed xmlns:a="{ATOM}"><a:link href="/opds/k3y/x"/></a:feed>', "dl/" + token("https://cat.org/opds/~key~/x")),
        (f'<feed xmlns="{ATOM}"><link href="a?x=1&#38;y=2&#x26;z"/></feed>', "dl/" + token("https://cat.org/opds/v1/a?x=1&y=2&z")),
        (f'<feed xmlns="{ATOM}"><!-- <link href="no"/> --><![CDATA[<link href="no"/>]]><link title=" href=\'no\' > " href=\'yes\'/></feed>', "dl/" + token("https://cat.org/opds/v1/yes")),
        (f'<feed xmlns="{ATOM}"><div xmlns="http://www.w3.org/1999/xhtml"><link href="no"/></div><h:link xmlns:h="u" href="no"/><link href="yes"/>', "dl/" + token("https://cat.org/opds/v1/yes")),
    ],
)
def test_any_prefix_and_reference(spark, text, want):
    got = whole(spark, text)
    assert got.count(f'href="http://me:80/my%20page/{want}"') == 1 and got.count("http://me:80") == 1


@pytest.mark.parametrize("text", ["<html>k3y</html>", '<feed><link href="https://cat.org/k3y/x', f'<feed xmlns="{ATOM}"><title>k3y</title></feed>', '{"a": "k3y"}', '["k3y"', "k3y", '<x:feed xmlns:x="else"><x:link href="/k3y"/></x:feed>', "<!-- k3y --><feed/>"])
def test_nothing_that_holds_the_key_gets_out(spark, text):
    assert whole(spark, text) is None


@pytest.mark.parametrize("text", ['<feed><link href="https://cat.org/x', "<feed><", "<a <b <c>", "<feed/>é<!-- ", '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><feed>&a;</feed></feed></x>', "< >", "<![CDATA["])
def test_broken_texts_stay_as_they_are(spark, text):
    assert whole(spark, text) == text


def test_json_by_pointers(spark):
    acq = "http://opds-spec.org/acquisition"
    book = {"metadata": {"title": "T", "numberOfPages": 250}, "links": [{"href": "/b", "rel": [acq, "x"]}, {"href": "/i", "rel": "self"}]}
    doc = {"a/b~": {"publications": [book, {"links": []}, 7, book]}, "publications": [{"links": [{"href": "/c", "rel": acq, "templated": True}]}], "alternate": [{"href": "/z"}]}
    got = json.loads(whole(spark, json.dumps(doc), parts=lambda href, pages: F.when(pages >= 200, 3).otherwise(1)))
    of = got["a/b~"]["publications"]
    assert [b["metadata"]["title"] if isinstance(b, dict) and "metadata" in b else b for b in of] == ["T (1 of 3)", "T (2 of 3)", "T (3 of 3)", {"links": []}, 7, "T (1 of 3)", "T (2 of 3)", "T (3 of 3)"]
    assert of[1]["links"][0]["href"].endswith("?part=2&parts=3") and "part=" not in of[1]["links"][1]["href"] and len(got["publications"]) == 1
    assert "templated" not in got["publications"][0]["links"][0] and got["alternate"][0]["href"] == f"http://me:80/my%20page/dl/{token('https://cat.org/z')}"


def test_feeds_of_a_small_file_are_dealt_to_all_tasks(spark):
    from foliant import registry

    assert registry.QUERIES["rewritten_feeds"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
