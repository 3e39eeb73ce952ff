"""Documents that are missing, broken or odd, and profiles that can't be inherited."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import documents, profiles


def test_odd_documents(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<feed"), (4, "<feed><entry><title>t</title></entry></feed>"), (5, '<feed><entry><link rel="next" href="/n"/></entry></feed>')], "k int, xml string")
    assert [tuple(r) for r in documents.browse(rows, "xml").collect()] == [(5, 0, "Untitled", "/n", None, False)]
    assert {r[0] for r in rows.select(documents.search_template(F.col("xml"))).collect()} == {None}
    assert {(tuple(r.i.authors), r.i.right_to_left) for r in rows.select(documents.comic_info(F.col("xml")).alias("i")).collect()} == {((), False)}
    assert documents.manifest_links(rows, "xml").count() == 0


def test_trail_goes_back(spark):
    steps = spark.createDataFrame([(["a", "b", "c", "b", "d"],), ([],), (["a", "a"],)], "s array<string>")
    assert [r[0] for r in steps.select(documents.trail(F.col("s"))).collect()] == [["a", "b", "d"], [], ["a"]]


def test_profiles(spark):
    raw = profiles.read_toml(spark, '[mixins.m]\ngamma = 2.0\ndeblock = true\n[profiles.a]\nbase = "m"\ngamma = 1.0\n[profiles.b]\nbase = "a"\n[profiles.x]\nbase = "y"\n[profiles.y]\nbase = "x"\n[profiles.z]\nbase = "gone"\n')
    found = {tuple(r) for r in profiles.inherited(raw).collect()}
    assert found == {("a", "gamma", "1.0"), ("a", "deblock", "true"), ("b", "gamma", "1.0"), ("b", "deblock", "true")}
    told = {(r.name, r.problem) for r in profiles.ancestry(raw).where("problem is not null").collect()}
    assert told == {("x", "cycle"), ("y", "cycle"), ("z", "unknown base")}
    with pytest.raises(ValueError):
        profiles.read_toml(spark, "[other.a]\nx = 1\n")


def test_chains_of_many_rows_and_of_any_length(spark):
    """A chain of 300, a cycle of three with two that lead to it, an unknown base; and a tree of more rows of ancestors than a recursive query may have."""
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("v", "x"), ("w", "v"), ("u", "gone"), ("t", "u")]
    raw = spark.createDataFrame([(n, b, False, "f", n) for n, b in rows if n in ("n0", "n7", "y", "u")] + [(n, b, False, None, None) for n, b in rows], profiles.RAW)
    told = {r.name: (r.depth, r.problem) for r in profiles.chains(raw).collect()}
    ends = {"x": (2, "cycle"), "y": (2, "cycle"), "z": (2, "cycle"), "v": (3, "cycle"), "w": (4, "cycle"), "u": (0, "unknown base"), "t": (1, "unknown base")}
    assert told == {f"n{i}": (i, None) for i in range(300)} | ends
    pairs = profiles.ancestry(raw)
    assert {r.name: (r.d, r.p) for r in pairs.groupBy("name").agg(F.max("depth").alias("d"), F.max("problem").alias("p")).collect()} == told
    assert pairs.count() == sum(d + 1 for d, _ in told.values()) == pairs.select("name", "depth").distinct().count()
    value = {r.name: r.value for r in profiles.inherited(raw).collect()}
    assert value == {f"n{i}": "n7" if i >= 7 else "n0" for i in range(300)} | dict.fromkeys("xyvw", "y") | {"z": "y", "u": "u", "t": "u"}
    tree = spark.range(1, 70_001).selectExpr("concat('p', id) as name", "case when id > 1 then concat('p', id div 2) end as base", "false as is_mixin", "case when id < 3 then 'f' end as field", "concat('p', id) as value")
    assert profiles.chains(tree).agg(F.sum("depth")).first()[0] == sum(i.bit_length() - 1 for i in range(1, 70_001))
    second = sum(bin(i)[2:].startswith("10") for i in range(1, 70_001))
    assert {tuple(r) for r in profiles.inherited(tree).groupBy("value").count().collect()} == {("p1", 70_000 - second), ("p2", second)}
