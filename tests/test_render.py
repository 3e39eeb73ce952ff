"""Pages: PNG there and back, geometry and levels by their properties."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import pixels
from foliant.operators import render
from foliant.operators.pages import bayer


def filtered(a, kind):
    """A PNG of 8 bits whose rows all have one filter."""
    h, w, bands = a.shape
    flat, rows = a.reshape(h, -1).astype(int), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * bands, int)
        left, corner = np.concatenate((np.zeros(bands, int), flat[y][:-bands])), np.concatenate((np.zeros(bands, int), up[:-bands]))
        p = left + up - corner
        near = np.stack((abs(p - left), abs(p - up), abs(p - corner)))
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return pixels.PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png_of_every_filter_is_read(bands):
    a = np.random.default_rng(bands).integers(0, 256, (9, 7, bands)).astype(np.uint8)
    for kind in range(5):
        assert (pixels.read_png(filtered(a, kind)) == a).all()
    assert pixels.head_size(filtered(a, 0)) == (7, 9)


def test_png_round_trips_and_bad_ones():
    r = np.random.default_rng(0)
    levels = r.integers(0, 16, (5, 7)).astype(np.uint8)
    assert (pixels.read_png(pixels.write_png(levels, 4))[..., 0] == levels * 17).all()
    palette = r.integers(0, 256, (16, 3)).astype(np.uint8)
    assert (pixels.read_png(pixels.write_png(levels, 8, palette)) == palette[levels]).all()
    whole = pixels.write_png(levels, 8)
    assert [pixels.read_png(x) for x in (b"", b"\xff\xd8\xff", whole[:50])] == [None] * 3
    assert pixels.head_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4) and pixels.head_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x11\x08\x00\x05\x00\x06") == (6, 5)


def test_the_dither_matrix_is_the_recursive_one():
    assert [round(v * 4 - 0.5) for v in bayer(2)] == [0, 2, 3, 1]
    assert sorted(round(v * 64 - 0.5) for v in bayer()) == list(range(64))
    assert [round(v * 64 - 0.5) for v in bayer()[:8]] == [0, 32, 8, 40, 2, 34, 10, 42]
    flat = np.full((64, 64), 100.0)
    assert abs(pixels.quantised(flat).mean() * 17 - 100) < 0.5


def test_geometry():
    page = np.full((200, 300), 250.0)
    page[20:180, 30:270] = 20
    assert abs(np.array(pixels.content_box(page)) - (28, 18, 272, 182)).max() <= 2
    page[0, 0] = 0  # a speck
    assert pixels.content_box(page)[0] > 20
    framed = np.full((100, 80), 255.0)
    framed[:, :2] = framed[-3:] = 0
    assert pixels.edge_lines(framed) == (2, 0, 0, 3)
    assert pixels.dark_sides(framed) == (True, False, False, True)
    assert np.allclose(pixels.scaled(np.arange(12.0).reshape(3, 4), 2, 3), [[0.5, 2.5], [4.5, 6.5], [8.5, 10.5]])
    assert pixels.scaled(np.full((5, 5), 7.0), 9, 2).shape == (2, 9) and np.allclose(pixels.scaled(np.full((5, 5), 7.0), 9, 2), 7)
    assert np.allclose(pixels.tone_table(10, 245, 1.0)[[10, 245]], [0, 255]) and (np.diff(pixels.tone_table(8, 240, 1.4)) >= 0).all()
    assert np.allclose(pixels.sharpened(np.full((6, 6), 50.0), 1.0), 50)


def test_pages_are_rendered(spark):
    a = np.full((120, 90, 3), 255, np.uint8)
    a[30:90, 20:70] = 10
    rows = [(1, filtered(a, 1), 0), (2, b"nonsense", 0), (3, None, 0), (4, filtered(a, 4), 50)]
    got = {r.id: r for r in render.render_pages(spark.createDataFrame(rows, "id int, content binary, most int"), "content", render.Panel(100, 140, crop=False), F.col("most")).collect()}
    page = pixels.read_png(bytes(got[1].page))[..., 0]
    assert page.shape == (140, 100) and (got[1].w, got[1].h, got[1].x) == (100, 133, 0) and page[70, 50] < 40 and page[1, 1] == 255
    assert (got[2].problem, bytes(got[2].page), got[3].problem, got[3].page) == ("unreadable", b"nonsense", "unreadable", None)
    assert pixels.read_png(bytes(got[4].page)).shape == (70, 50, 1)
    sizes = {r.id: r.size for r in render.image_sizes(spark.createDataFrame(rows, "id int, content binary, most int"), "content").collect()}
    assert (sizes[1].width, sizes[1].height) == (90, 120) and sizes[2] is None and sizes[3] is None
    noise = np.random.default_rng(1).integers(0, 256, (120, 90, 1)).astype(np.uint8)
    pairs = spark.createDataFrame([(filtered(a, 2), filtered(a, 0)), (filtered(noise, 0), filtered(a, 0)), (None, filtered(a, 0))], "a binary, b binary")
    assert [r.needed for r in render.differing_covers(pairs, "a", "b").collect()] == [False, True, False]
