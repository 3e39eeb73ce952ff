"""Ranged archives, the archive sink, and repacking from end to end."""

import http.server
import io
import os
import random
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.operators.repack import archive_totals, repack
from foliant.sources.ranged import BLOCK, RangedFile, entry_head, open_ranged, probed_size, read_ranged, whole_body
from foliant.sources.zip_sink import write_archives

PNG, JPG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"


@pytest.mark.parametrize("block", [1, 7, 64])
def test_ranged_file_reads_as_a_file(block):
    r = random.Random(block)
    data = bytes(r.choices(range(256), k=1000))
    for ahead in (1, 3):
        file, plain = RangedFile(lambda a, z: data[a:z], len(data), block, ahead), io.BytesIO(data)
        for _ in range(300):
            if r.random() < 0.4:
                where = r.choice([(r.randrange(1001), 0), (r.randrange(-900, 1), 2), (-plain.tell() // 2, 1)])
                assert file.seek(*where) == plain.seek(*where)
            n = r.choice([0, 1, 5, 63, 64, 200, -1, None])
            assert file.read(n) == plain.read(-1 if n is None else n) and file.tell() == plain.tell()
            assert len(file.blocks) <= ahead
            a, n, held = r.randrange(1000), r.randrange(90), list(file.blocks)
            assert file.sample(a, n) == data[a : a + n] and list(file.blocks) == held
    assert file.seek(-5) == 0 and file.seek(5000) == 1000 and file.sample(-1, 5) == b""
    with pytest.raises(ValueError):
        file.seek(0, 9)


class Handler(http.server.BaseHTTPRequestHandler):
    files, sent, ranges = {}, 0, True

    def do_GET(self):  # noqa: N802
        body = Handler.files.get(self.path)
        if body is None:
            return self.send_error(404)
        asked = self.headers.get("Range") if Handler.ranges else None
        a, z = (int(x) for x in asked.split("=")[1].split("-")) if asked else (0, len(body) - 1)
        self.send_response(206 if asked else 200)
        if asked:
            self.send_header("Content-Range", f"bytes {a}-{min(z, len(body) - 1)}/{len(body)}")
        part = body[a : z + 1]
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)
        Handler.sent += len(part)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Handler.files, Handler.sent, Handler.ranges = {}, 0, True
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def archive(entries, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_one_entry_of_an_archive_without_the_rest(spark, server):
    r = random.Random(1)
    big = [(f"p{i}.png", PNG + r.randbytes(3 << 20)) for i in range(10)]
    Handler.files["/a.cbz"] = archive(big)
    assert probed_size(f"{server}/a.cbz", {}) == len(Handler.files["/a.cbz"])
    entries = read_ranged(spark, [f"{server}/a.cbz", f"{server}/none.cbz"], content="none").collect()
    assert {(e.name, e.file_size) for e in entries} == {(n, len(d)) for n, d in big} and Handler.sent < 2 * BLOCK
    Handler.sent = 0
    one = read_ranged(spark, [f"{server}/a.cbz"], ["p4.png"]).collect()
    assert [bytes(e.content) for e in one] == [big[4][1]] and Handler.sent < 8 * BLOCK
    Handler.sent = 0
    heads = read_ranged(spark, [f"{server}/a.cbz"], ["p1.png", "p9.png"], content="head").collect()
    assert {bytes(e.content) for e in heads} == {big[1][1][: 32 << 10], big[9][1][: 32 << 10]} and Handler.sent < 2 * BLOCK
    parts = read_ranged(spark, [f"{server}/a.cbz"], partitionbytes=5 << 20)
    assert parts.rdd.getNumPartitions() == 7 and {bytes(e.content) for e in parts.collect()} == {d for _, d in big}


def test_a_server_without_ranges(spark, server):
    Handler.files["/a.cbz"], Handler.ranges = archive([("1.png", PNG)]), False
    assert probed_size(f"{server}/a.cbz", {}) is None
    assert read_ranged(spark, [f"{server}/a.cbz"]).count() == 0
    assert [e.name for e in read_ranged(spark, [f"{server}/a.cbz"], most=1000).collect()] == ["1.png"]
    with pytest.raises(OSError, match="longer than 20"):
        whole_body(f"{server}/a.cbz", {}, 20)


def test_an_archive_of_more_than_two_gigabytes(spark, tmp_path):
    """Listed, and its last entry read, from a file with a hole of 2.2 GB."""
    size = (1 << 31) + 200_000_000
    with open(tmp_path / "big.cbz", "w+b") as f:
        first = zipfile.ZipInfo("big.bin")
        first.file_size, first.compress_size, first.CRC = size, size, 0
        f.write(first.FileHeader(zip64=False))
        f.truncate(f.tell() + size)
        with zipfile.ZipFile(f, "a") as z:
            first.header_offset = 0
            z.writestr("last.png", PNG + b"end")
            z.filelist.insert(0, first)
            z.start_dir = f.tell()
            z._didModify = True
    got = read_ranged(spark, [str(tmp_path / "big.cbz")], content="head").select("name", "file_size", "offset", F.length("content").alias("n")).collect()
    assert {(e.name, e.file_size, e.n) for e in got} == {("big.bin", size, 32 << 10), ("last.png", 11, 11)}
    assert read_ranged(spark, [str(tmp_path / "big.cbz")], ["last.png"]).select("content").first().content == PNG + b"end"


def test_heads_of_entries():
    data = random.Random(2).randbytes(200_000)
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        body = archive([("a", data)], method)
        head = entry_head(RangedFile(lambda a, z: body[a:z], len(body)), zipfile.ZipFile(io.BytesIO(body)).infolist()[0])  # noqa: B023
        assert head is None if method == zipfile.ZIP_BZIP2 else data.startswith(head) and len(head) > 30_000


def contents(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return [(i.filename, z.read(i)) for i in z.infolist()]


def test_sink_writes_whole_books(spark, tmp_path):
    books = {f"dir/b{i}.cbz": [(f"{j:04}.png", PNG + bytes([i, j]) * (j * 1000)) for j in range(20)] for i in range(6)}
    rows = [(b, j, n, d) for b, entries in books.items() for j, (n, d) in enumerate(entries)]
    rows += [("dir/b0.cbz", 99, "null.png", None), (None, 0, "x", b"x"), ("empty.cbz", 0, "x", None)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file string, place long, name string, content binary, part string").repartition(5)
    for _ in range(2):  # the second time files are replaced
        write_archives(df, str(tmp_path))
    assert {b: contents(tmp_path / b) for b in books} == books and contents(tmp_path / "empty.cbz") == []
    assert sorted(os.listdir(tmp_path)) == ["dir", "empty.cbz"]


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    (tmp_path / "a.cbz").write_bytes(b"as it was")
    df = spark.createDataFrame([("a.cbz", i, f"{i}.png", PNG) for i in range(50)], "file string, place long, name string, content binary")
    dies = df.withColumn("content", F.when(F.col("place") == 49, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        write_archives(dies, str(tmp_path))
    assert os.listdir(tmp_path) == ["a.cbz"] and (tmp_path / "a.cbz").read_bytes() == b"as it was"
    no_name = df.withColumn("name", F.when(F.col("place") == 49, F.lit(None)).otherwise(F.col("name")))
    with pytest.raises(Exception):  # noqa: B017  within the writer itself, when most of the book is written
        write_archives(no_name, str(tmp_path))
    assert os.listdir(tmp_path) == ["a.cbz"]


def test_repack_from_end_to_end(spark, tmp_path):
    page = lambda i, n: JPG + bytes([i]) * n
    books = {
        "one": [("v1/p10.png", page(1, 900)), ("v1/p2.png", PNG + b"2"), ("__MACOSX/._p.png", b"junk"), ("notes.txt", b"hello"), ("v2/p1.jpg", page(3, 800)), ("v2/p3.gif", b"GIF89a"), ("d/", b"")],
        "two": [("1.jpg", page(4, 10)), ("comicinfo.xml", b"<own/>"), ("Thumbs.db", b"junk")],
    }
    for name, entries in books.items():
        (tmp_path / f"{name}.zip").write_bytes(archive(entries, zipfile.ZIP_DEFLATED))
    entries = read_ranged(spark, [str(tmp_path / f"{n}.zip") for n in books])
    totals = {os.path.basename(r.archive): (r.entries, r.images, r.junk, r.declared) for r in archive_totals(entries).collect()}
    assert totals == {"one.zip": (5, 4, 1, 903 + 9 + 5 + 803 + 6), "two.zip": (2, 1, 1, 13 + 6)}
    of = entries.select("archive").distinct()
    covers, records = of.withColumn("content", F.when(F.col("archive").contains("one"), F.lit(PNG + b"cover"))), of.withColumn("content", F.lit(b"<new/>"))
    write_archives(repack(entries, 1, covers, records), str(tmp_path / "whole"))
    assert contents(tmp_path / "whole/one.cbz") == [("0000.png", PNG + b"cover"), ("notes.txt", b"hello"), ("0001.png", PNG + b"2"), ("0002.jpg", page(1, 900)), ("0003.jpg", page(3, 800)), ("0004.gif", b"GIF89a"), ("ComicInfo.xml", b"<new/>")]
    assert contents(tmp_path / "whole/two.cbz") == [("0001.jpg", page(4, 10)), ("comicinfo.xml", b"<own/>")]
    write_archives(repack(entries.where(F.col("archive").contains("one")), 2), str(tmp_path / "parts"))
    assert [n for n, _ in contents(tmp_path / "parts/one (1 of 2).cbz")] == ["notes.txt", "0001.png", "0002.jpg"]
    assert [n for n, _ in contents(tmp_path / "parts/one (2 of 2).cbz")] == ["notes.txt", "0003.jpg", "0004.gif"]


def test_odd_archives(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    body = bytearray(archive([("a.png", PNG + b"x" * 100)]))
    body[45] ^= 1
    (tmp_path / "torn.zip").write_bytes(bytes(body))
    got = read_ranged(spark, [str(tmp_path / n) for n in ("bad.zip", "torn.zip", "missing.zip")]).collect()
    assert [(e.name, e.content) for e in got] == [("a.png", None)] and zlib.crc32(b"") == 0
    assert read_ranged(spark, []).count() == 0
    assert open_ranged(str(tmp_path / "bad.zip"), {}).read(2) == b"no"
