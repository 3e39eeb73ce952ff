"""Small cases worked out by hand."""

from pyspark.sql import functions as F

from foliant.functions.stats import floor_rank, sixteen_levels
from foliant.functions.strings import decode_token, encode_token, human_bytes, is_image, is_junk, natural_key, note
from foliant.operators.windows import as_of, islands, newest


def col(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expr(F.col("v"))).collect()]


def test_natural_order_compares_digits_as_numbers(spark):
    names = ["p10.png", "P2.png", "p2a.png", "ch1/p03.png", "p" + "9" * 40, None]
    got = [r.v for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(natural_key(F.col("v")), "v").collect()]
    assert got == [None, "ch1/p03.png", "P2.png", "p2a.png", "p10.png", "p" + "9" * 40]


def test_junk_and_images(spark):
    paths = ["__MACOSX/._p1.png", ".hidden/p.png", "sub\\desktop.ini", "a/Thumbs.db", "ch/P03.JPG", "notes.txt", "ch/.p.png"]
    assert col(spark, paths, is_junk) == [True, True, True, True, False, False, True]
    assert col(spark, paths, is_image) == [False, True, False, False, True, False, False]


def test_tokens_of_any_length_come_back(spark):
    texts = ["a" * n for n in range(1, 9)] + ["é" * 80, "x/y?z=1&ü"]
    assert col(spark, texts, lambda c: decode_token(encode_token(c))) == texts
    assert all(not set(t) & set("+/=\r\n") for t in col(spark, texts, encode_token))


def test_labels(spark):
    assert col(spark, [0, 1023, 1024, 3 * 1024**2], human_bytes, "long") == ["0 B", "1023 B", "1.0 KB", "3.0 MB"]
    assert col(spark, ["a \n b", "x" * 141, ""], note) == ["a b", "x" * 139 + "…", ""]
    assert col(spark, [0.0, 8.5, 25.5, 255.0, 300.0], sixteen_levels, "double") == [0, 0, 2, 15, 15]


def test_floor_rank_does_not_interpolate(spark):
    for n, want in ((1, 0), (2, 1), (10, 9), (11, 9)):
        assert spark.range(n).agg(floor_rank(F.col("id"), 0.9)).first()[0] == want


def test_windows(spark):
    df = spark.createDataFrame([("u", i, f) for i, f in enumerate([True, True, False, None, True, True, True])], "k string, i int, f boolean")
    assert sorted(map(tuple, islands(df, F.col("f"), ["k"], ["i"], 3).collect())) == [("u", 4, 6, 3)]
    assert [r.i for r in newest(df, ["k"], [F.desc("i")], 2).orderBy("i").collect()] == [5, 6]


def test_as_of_takes_the_latest_row_not_after(spark):
    left = spark.createDataFrame([("u", 5, "a"), ("u", 0, "b"), ("w", 9, "c")], "k string, t int, name string")
    right = spark.createDataFrame([("u", 1, 10), ("u", 5, 50), ("u", 6, 60)], "k string, t int, v int")
    assert {r.name: r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect()} == {"a": 50, "b": None, "c": None}


def test_sizes_on_half_a_tenth_go_to_the_even_tenth(spark):
    sizes = [1280, 1792, 3328, 894_208, 1024**2 + 1024**2 // 4, 1024**2 - 1, 3 * 1024**3 + 3 * 1024**3 // 4, 5 * 1024**4 + 7, -5]
    texts = [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" if n < 1024**3 else f"{n / 1024**3:.1f} GB" for n in sizes]
    assert texts[:2] == ["1.2 KB", "1.8 KB"] and col(spark, sizes, human_bytes, "long") == texts


def test_smooth_lengths_of_any_size(spark):
    from foliant.operators import pages

    rows = spark.createDataFrame([(n,) for n in (None, 0, 1, 11, 4096, 4097, 1 << 20, (1 << 40) + 1, (1 << 62) + 1, (1 << 63) - 1)], "n long")
    free = [r[0] for r in rows.select(pages.smooth_length(F.col("n"))).collect()]
    bound = [r[0] for r in rows.select(pages.smooth_length(F.col("n"), (11, 7, 5, 4))).collect()]

    def least(n, most):  # the least multiple of a power of two of each product of the others
        odd = [3**b * 5**c * 7**d for b in range(most[1] + 1) for c in range(most[2] + 1) for d in range(most[3] + 1)]
        found = [m << k for m in odd for k in range(most[0] + 1) if n <= m << k < 1 << 63]
        return min(found, default=None)

    for got, most in ((free, (62, 39, 27, 22)), (bound, (11, 7, 5, 4))):
        assert got == [None if r.n is None else least(r.n, most) for r in rows.collect()]
    assert free[4:6] == [4096, 4116] and bound[4] == 4116 and bound[-2] is None


def test_marks_read_as_lines_are_trusted_at_less(spark):
    from foliant.operators import pages

    marks = spark.createDataFrame([(p, 1, 0.0, 0.0, 10.0, 4.0) for p in range(5)], "page int, mark int, mx0 double, my0 double, mx1 double, my1 double")
    reads = spark.createDataFrame([(0, "12", 0.92), (1, "7", 0.92), (2, "7", 0.96), (3, "12", 0.89), (4, "0", 0.99)], "page int, text string, score double").selectExpr("*", "1d as x0", "0d as y0", "11d as x1", "4d as y1")
    assert sorted(r.page for r in pages.read_marks(marks, reads, "page").collect()) == [2]
    assert sorted(r.page for r in pages.read_marks(marks, reads, "page", lines=True).collect()) == [0, 2]
