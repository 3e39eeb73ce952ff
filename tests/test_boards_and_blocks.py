"""Boards, caches, blocks and sampled digests against plain passes."""

import hashlib
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.functions import records
from foliant.functions.digests import PLACES, SAMPLE, sampled_md5
from foliant.operators.pages import empty_tiles, strip_parts, trim_cache
from foliant.operators.windows import running_before
from foliant.streaming.boards import ASKED, UPDATES, board_stands, boards_of_stream, cached_answers

T0 = datetime(2024, 1, 1)


def plain_board(rows, most, stay):
    board, out = OrderedDict(), []
    for _, ts, job, *new in rows:
        if job is None or job == "no/job":
            continue
        old = board.pop(job, {"stage": "starting", "done": 0, "total": 0})
        board[job] = old | {k: v for k, v in zip(("stage", "done", "total"), new) if v is not None} | {"at": ts}
        for k in [k for k, v in board.items() if (ts - v["at"]).total_seconds() > stay]:
            del board[k]
        while len(board) > most:
            board.popitem(last=False)
        out.append((ts, job, *(board[job][k] for k in ("stage", "done", "total")), len(board)))
    return out


@pytest.fixture(scope="module")
def updates():
    r = random.Random(1)
    none = lambda v: r.choice([None, v, v])
    at = lambda i: T0 + timedelta(seconds=i * 40)
    return [(b, at(i) + timedelta(seconds=r.choice([0, 5]) if b else 0), r.choice([None, "no/job", *"abcdefgh"]) if b == "x" else f"j{r.randrange(200)}", none(f"s{i}"), none(i), none(2 * i)) for b in ("x", "y") for i in range(300)]


def in_order(rows):
    return sorted(rows, key=lambda r: [r[0], r[1], *((v is not None, v) for v in r[2:])])


def test_boards(spark, updates):
    df = spark.createDataFrame([*updates, (None, T0, "a", None, None, None), ("x", None, "a", None, None, None)], UPDATES).repartition(4)
    for most, stay in ((64, 900), (5, 300), (1, 0)):
        got = board_stands(df, most, stay).collect()
        for b in ("x", "y"):
            assert [tuple(r)[1:] for r in got if r.board == b] == plain_board(in_order([u for u in updates if u[0] == b]), most, stay)
    assert board_stands(spark.createDataFrame([], UPDATES)).count() == 0


def test_boards_of_a_stream_go_on_over_batches(spark, updates, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = in_order(updates)
    for i in range(3):
        spark.createDataFrame([u for u in rows if T0 + timedelta(hours=1.2 * i) <= u[1] < T0 + timedelta(hours=1.2 * (i + 1))], UPDATES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = boards_of_stream(stream, 5, 300).writeStream.format("memory").queryName("stands").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("stands").collect()
    for b in ("x", "y"):
        assert sorted(map(str, (tuple(r)[1:] for r in got if r.board == b))) == sorted(map(str, plain_board([u for u in rows if u[0] == b], 5, 300)))


def test_answers_are_cleared_at_a_number(spark):
    r = random.Random(2)
    asked = [("c", T0 + timedelta(seconds=20 * i), f"k{r.randrange(30)}", r.choice([True, False, None])) for i in range(600)]
    until, want = {}, []
    for _, ts, key, found in asked:
        hit = key in until and ts < until[key][0]
        if not hit:
            if len(until) > 12:
                until.clear()
            until[key] = ts + timedelta(seconds=900 if found else 300), bool(found)
        want.append((ts, key, hit, until[key][1], len(until)))
    got = [tuple(x)[1:] for x in cached_answers(spark.createDataFrame(asked, ASKED).repartition(3), 12).collect()]
    assert got == want and len({w[2] for w in want}) == 2 and max(w[4] for w in want) == 13


def plain_blocks(sizes, limit):
    block, used, held, out = 0, 0, 0, []
    for n in sizes:
        if held and used + n > limit:
            block, used, held = block + 1, 0, 0
        out.append((block, used))
        held += 1
        used += n
    return out


def test_blocks_equal_a_plain_pass(spark):
    r = random.Random(3)
    books = {b: [r.choice([0, 1, 5, 99, 100, 101, 250, r.randrange(60)]) for _ in range(n)] for b, n in ((None, 3), (1, 400), (2, 1), (3, 90))}
    df = spark.createDataFrame([(b, i, n, "clash") for b, sizes in books.items() for i, n in enumerate(sizes)], "book int, at long, n long, used string").repartition(3)
    got = records.blocked(df, "book", ["at"], "n", 100).collect()
    for b, sizes in books.items():
        assert [(x.block, x["place"]) for x in sorted((x for x in got if x.book == b), key=lambda x: x.at)] == plain_blocks(sizes, 100)
    index = records.index_blocks(df, "book", "at", "n", 100).collect()
    assert [x.block for x in sorted((x for x in index if x.book == 1), key=lambda x: x.at)] == [b for b, _ in plain_blocks([n + 2 for n in books[1]], 100)]


def test_a_book_of_a_million_entries(spark):
    rows = spark.range(1_000_000).select(F.lit("one").alias("book"), F.col("id").alias("at"), (F.col("id") % 300).alias("n"))
    last = records.index_blocks(rows, "book", "at", "n").agg(F.max("block").alias("b"), F.count("*").alias("c")).first()
    assert (last.b, last.c) == (plain_blocks([i % 300 + 2 for i in range(1_000_000)], records.INDEX_BLOCK)[-1][0], 1_000_000)


@pytest.mark.parametrize("chunk", [1 << 20, 1000, 1, 0])
def test_digests_do_not_depend_on_chunks(spark, chunk):
    r = random.Random(4)
    files = {f"f{n}": r.randbytes(n) for n in (0, 5, 1024, 1500, 5000, 70_000, 5_000_000)}
    rows = []
    for name, data in files.items():
        if chunk == 1 and len(data) > 6000:
            continue
        at = no = 0
        while at < len(data) or not no:
            step = chunk or r.choice([0, 1, 700, 90_000])
            rows.append((name, no, data[at : at + step] if at < len(data) or r.random() < 0.5 else None))
            at, no = at + step, no + 1
    got = {x.file: (x.size, x.digest) for x in sampled_md5(spark.createDataFrame(rows, "file string, no int, content binary").repartition(4), "file", "no", "content").collect()}
    assert got == {n: (len(d), hashlib.md5(b"".join(d[p : p + SAMPLE] for p in PLACES)).hexdigest()) for n, d in files.items() if n in got} and "f5000" in got


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "cache string, mtime long, size long")
    assert sorted((str(r.cache), r.before) for r in running_before(rows, ["cache"], ["mtime"], "size").collect()) == [("None", 0), ("None", 5), ("a", 0)]
    entries = rows.withColumn("path", F.col("mtime").cast("string"))
    kept = trim_cache(entries, "cache", F.lit(6), lambda df, keys, order, column: running_before(df, keys, order, column))
    assert sorted((str(r.cache), r.mtime) for r in kept.collect()) == [("a", 1)]
    tiles = empty_tiles(spark.createDataFrame([(None, 1, 0), (None, 2, 0), ("b", 1, 9)], "book string, tile int, ink int"), ["book", "tile"], F.col("ink"), 1.0)
    assert sorted((str(r.book), r.tile, r.empty) for r in tiles.collect()) == [("None", 1, False), ("None", 2, True), ("b", 1, False)]
    sizes = spark.createDataFrame([(None, 1, 800, 80_000), ("b", 1, 800, 80_000)], "book string, page int, w int, h int")
    assert {r.parts for r in strip_parts(sizes, "book", F.lit(3000), 1000).collect()} == {strip_parts(sizes.where("book = 'b'"), "book", F.lit(3000), 1000).first().parts}
