"""Names, headers and ids, case by case."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import names, records
from foliant.functions.records import aligned


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean", bytes: "binary", type(None): "string", dict: "map<string,string>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "job", "rest"), [("a-1", True, True), ("A_1", False, True), ("", False, False), ("x" * 64, True, True), ("x" * 65, False, False), ("a/b", False, False), ("é", False, False), ("a\n", False, False), (None, False, False)])
def test_ids(spark, value, job, rest):
    assert one(spark, names.job_id(F.col("v")), v=value) == (value if job else None)
    assert one(spark, names.rest_id(F.col("v")), v=value) == (value if rest else None)


@pytest.mark.parametrize(("mime", "url", "want"), [(None, "http://x/a", True), (" ", "http://x/a", True), ("application/zip", "http://x/a", True), ("text/html", "http://x/a.CBZ", True), ("text/html", "http://x/a", False)])
def test_archive_links(spark, mime, url, want):
    assert one(spark, names.archive_link(F.col("m"), F.col("u")), m=mime, u=url) is want


def test_headers_that_are_passed_on(spark):
    headers = {"content-type": "a", "ETag": "b", "set-cookie": "c", "last-modified": "d", "content-disposition": "e"}
    assert one(spark, names.passed_headers(F.col("h")), h=headers) == {"content-type": "a", "ETag": "b", "last-modified": "d", "content-disposition": "e"}
    assert one(spark, names.passed_headers(F.col("h"), True), h=headers) == {"content-disposition": "e"}


@pytest.mark.parametrize(("status", "want"), [(200, (200, None)), (401, (401, "Basic")), (407, (502, None)), (404, (404, None)), (500, (502, None)), (599, (502, None))])
def test_statuses(spark, status, want):
    assert tuple(one(spark, names.told_status(F.col("s"), F.lit("Basic")), s=status)) == want


@pytest.mark.parametrize(("count", "estimate", "want"), [(199, 9, 1), (200, 9, 9), (200, 1, 1), (5000, 400, 99), (200, 0, 1)])
def test_parts_of_an_entry(spark, count, estimate, want):
    assert one(spark, names.book_parts(F.col("c"), F.col("e")), c=count, e=estimate) == want


def test_credentials_tell_callers_apart(spark):
    key = lambda h: one(spark, names.credential_key(F.col("h")), h=h)
    a = key({"authorization": "x", "cookie": "y", "accept": "z"})
    assert a == key({"cookie": "y", "authorization": "x"}) and a != key({"authorization": "x"}) and len(a) == 64 and a != key({})


def test_trails_there_and_back(spark):
    rows = [(f"t{i}", f"  Näme\t{i}\n " + "x" * 80) for i in range(11)]
    df = spark.createDataFrame([(rows,)], "r array<struct<token:string,name:string>>").select(names.trail_token(F.col("r")).alias("t"))
    row = df.select("t", names.trail_rows(F.col("t")).alias("back")).first()
    assert "=" not in row.t and [(b.token, b.name) for b in row.back] == [(t, " ".join(n.split())[:60]) for t, n in rows[-8:]]


@pytest.mark.parametrize(("name", "fmt", "reslice", "want"), [("kindle-a", "webpc", False, "pngc"), ("kindle-a", "png", False, "png"), ("kindle-a", "raw", False, None), ("kindle-a", "png", True, None), ("tablet", "png", False, None)])
def test_kindle_profiles(spark, name, fmt, reslice, want):
    assert one(spark, names.kindle_profile(F.col("n"), F.col("f"), F.col("r")), n=name, f=fmt, r=reslice) == want


@pytest.mark.parametrize(("json", "want"), [("7", 7), ('"12"', 12), ('"x"', None), ("true", None), ("1.5", None), ("null", None), ('"-3"', None)])
def test_numbers_of_json(spark, json, want):
    assert one(spark, names.variant_int(F.try_parse_json(F.col("j"))), j=json) == want


@pytest.mark.parametrize("n", range(9))
def test_aligned(spark, n):
    got = bytes(one(spark, aligned(F.col("b")), b=b"x" * n))
    assert got == b"x" * n + bytes(-n % 4)


def test_later_of(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 5, "c"), (1, 4, "d")], "k int, at int, v string")
    assert {(r.k, r.v) for r in records.later_of(rows, ["k"], ["at"]).collect()} == {(None, "b"), (1, "c")}
