import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.sources.archives import in_order, named, read_archives, to_archives
from foliant.streaming.downloads import newest_of_batch, one_at_a_time, sessions, stale_downloads


def test_archives_are_read_ordered_named_and_written(spark, tmp_path):
    png, jpg = b"\x89PNG\r\n\x1a\n123", b"\xff\xd8\xff123"
    with zipfile.ZipFile(tmp_path / "a.cbz", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [("p10.png", png), ("p2.png", jpg), ("__MACOSX/._p1.png", png), ("ComicInfo.xml", b"<a/>"), ("Ch 1/P03.JPG", jpg), ("d/", b"")]:
            z.writestr(name, data)
    (tmp_path / "b.cbz").write_bytes(b"not a zip")
    entries = read_archives(spark, f"{tmp_path}/*.cbz")
    assert entries.count() == 5
    pages = named(in_order(entries))
    assert {(r.page, r.name) for r in pages.collect()} == {(1, "0001.jpg"), (2, "0002.jpg"), (3, "0003.png"), (None, "ComicInfo.xml")}
    out = to_archives(pages).collect()
    assert len(out) == 1 and zipfile.ZipFile(io.BytesIO(bytes(out[0].content))).namelist() == ["0001.jpg", "0002.jpg", "0003.png", "ComicInfo.xml"]


T0 = datetime(2024, 1, 1)
ROWS = [("a", "page", 0), ("a", "page", 60), ("a", "done", 90), ("a", "page", 95), ("b", "page", 10), ("c", None, 4000), ("b", "page", 20)]


def stream(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        data = spark.createDataFrame([(k, s, T0 + timedelta(seconds=t)) for k, s, t in rows], "id string, stage string, ts timestamp")
        data.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema("id string, stage string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def result(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_downloads_end_or_are_lost(spark, tmp_path):
    got = result(spark, stale_downloads(stream(spark, tmp_path, [ROWS, [("d", "page", 9000)], [("d", "page", 9001)]])), tmp_path)
    assert {(r.id, r.state, r.steps) for r in got} == {("a", "done", 3), ("b", "lost", 2), ("c", "lost", 1)}


def test_sessions(spark, tmp_path):
    got = result(spark, sessions(stream(spark, tmp_path, [ROWS, [("d", "page", 9000)], [("d", "page", 9001)]])), tmp_path)
    assert {(r.id, r.steps) for r in got} == {("a", 4), ("b", 2), ("c", 1)}


def test_repeats_within_the_watermark_go(spark, tmp_path):
    got = result(spark, one_at_a_time(stream(spark, tmp_path, [ROWS, ROWS]), ["id"]), tmp_path)
    assert sorted(r.id for r in got) == ["a", "b", "c"]


def test_newest_of_batch(spark):
    kept = []
    newest_of_batch(lambda df: kept.extend(df.collect()), "id", "ts")(spark.createDataFrame(ROWS, "id string, stage string, ts int"), 0)
    assert {(r.id, r.ts) for r in kept} == {("a", 95), ("b", 20), ("c", 4000)}
