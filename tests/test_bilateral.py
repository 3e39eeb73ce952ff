"""The bilateral grid against dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators.bilateral import bilateral_means, held_change

NEAR, ACROSS, STEP = (0.050, 0.472, 1.0, 0.472, 0.050), (12 / 44, 20 / 44, 12 / 44), 2.5


def densely(value, share, zoom):
    h, w = value.shape
    rows, cols = (h - 1) // zoom + 1, (w - 1) // zoom + 1
    first, levels = int(np.floor(value.min() / STEP)) - 3, int(value.max() // STEP - value.min() // STEP) + 9
    grid = np.zeros((rows, cols, levels, 2))
    for y in range(h):
        for x in range(w):
            at = value[y, x] / STEP - first
            low = int(np.floor(at))
            for level, part in ((low, 1 - at + low), (low + 1, at - low)):
                grid[y // zoom, x // zoom, level] += share[y, x] * part * np.array([1, value[y, x]])
    blurred = np.zeros_like(grid)
    for level in range(levels):
        for k, a in zip(range(-2, 3), NEAR):
            if 0 <= level + k < levels:
                blurred[:, :, level] += a * grid[:, :, level + k]
    for axis, n in ((0, rows), (1, cols)):
        blurred = sum(a * np.take(blurred, np.clip(np.arange(n) + k, 0, n - 1), axis) for k, a in zip((-1, 0, 1), ACROSS))
    out = np.full(value.shape, np.nan)
    for y in range(h):
        for x in range(w):
            if share[y, x] <= 0:
                continue
            at, half, total = value[y, x] / STEP - first, zoom // 2, np.zeros(2)
            for dy in (0, 1):
                for dx in (0, 1):
                    for dl in (0, 1):
                        cy, cx = (y + half) // zoom - 1 + dy, (x + half) // zoom - 1 + dx
                        fy, fx, fl = ((y + half) % zoom + 0.5) / zoom, ((x + half) % zoom + 0.5) / zoom, at % 1
                        if 0 <= cy < rows and 0 <= cx < cols:
                            total += (fy if dy else 1 - fy) * (fx if dx else 1 - fx) * (fl if dl else 1 - fl) * blurred[cy, cx, int(at) + dl]
            out[y, x] = total[1] / total[0]
    return out


@pytest.mark.parametrize("zoom", [4, 8, 1])
def test_means_equal_dense_arrays(spark, zoom):
    r = np.random.default_rng(zoom)
    pages = {None: (17, 23), "a": (8, 8), "b": (1, 5)}
    data = {p: (np.round(r.random(s) * 20 - 4, 3), np.where(r.random(s) < 0.2, 0, np.round(r.random(s), 2))) for p, s in pages.items()}
    data["flat"] = (np.full((6, 6), 5.0), np.ones((6, 6)))
    rows = [(p, y, x, float(s[y, x]), float(v[y, x])) for p, (v, s) in data.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    squares = spark.createDataFrame(rows, "page string, y long, x long, share double, value double").repartition(3)
    got = bilateral_means(squares, "page", zoom, STEP, NEAR, ACROSS).collect()
    for p, (v, s) in data.items():
        want = densely(v, s, zoom)
        found = {(g.y, g.x): g["mean"] for g in got if g.page == p}
        assert len(found) == (s > 0).sum()
        assert all(abs(m - want[at]) < 1e-6 for at, m in found.items())
    assert all(abs(g["mean"] - 5) < 1e-9 for g in got if g.page == "flat")


def test_changes_are_held(spark):
    rows = spark.createDataFrame([(1.0, 9.0), (9.0, 1.0), (2.0, 3.0)], "old double, new double")
    assert [r.x for r in rows.select(held_change(F.col("new"), F.col("old"), 2.5).alias("x")).collect()] == [3.5, 6.5, 3.0]
