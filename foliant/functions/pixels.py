"""Page images as arrays: PNG in and out, and the steps from a decoded page to sixteen levels on a panel. Plain numpy, for use within tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliant.operators.pages import bayer

# Channels of PNG's colour types; how lines at an edge and dark sides are told; the mark of a PNG.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
LINE_INK, LINE_CLEAR, LINE_LOOK, LINE_MOST = 0.9, 0.05, 6, 4
FLAT_SPREAD, MIDDLE = 17, 128
PNG_MARK = b"\x89PNG\r\n\x1a\n"


def head_size(head: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the first bytes of a PNG, GIF or JPEG; None of anything else."""
    if not head:
        return None
    if head[:8] == PNG_MARK and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def read_png(data: bytes) -> np.ndarray | None:
    """(rows, columns, bands) of 8 bits, of a PNG that isn't interlaced; palettes are looked up, 16 bits become 8. None if unreadable."""
    try:
        if data[:8] != PNG_MARK:
            return None
        at, body, palette, clear = 8, [], None, b""
        width = height = depth = kind = 0
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            if name == b"IHDR":
                width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
                if interlaced:
                    return None
            elif name == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                clear = part
            elif name == b"IDAT":
                body.append(part)
            at += 12 + size
        bands = CHANNELS[kind]
        line, step = -(-width * bands * depth // 8), max(1, bands * depth // 8)
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (line + 1)].reshape(height, line + 1)
        rows = np.zeros((height, line), np.uint8)
        for y in range(height):
            rows[y] = _unfiltered(raw[y, 0], raw[y, 1:], rows[y - 1] if y else np.zeros(line, np.uint8), step)
        if depth == 16:
            out = rows[:, ::2]
        elif depth == 8:
            out = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
            out = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * bands]
            out = out if kind == 3 else out * np.uint8(255 // ((1 << depth) - 1))
        out = out.reshape(height, width, bands)
        if kind == 3:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out = np.concatenate((palette[out[..., 0]], alpha[out]), axis=2) if clear else palette[out[..., 0]]
        return out
    except (zlib.error, struct.error, ValueError, KeyError, TypeError, IndexError):
        return None


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        out = line.copy()
        for c in range(step):
            out[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        return out
    out, left, corner = [0] * len(line), [0] * step, [0] * step
    for i, (v, b) in enumerate(zip(line.tolist(), above.tolist())):
        a, c = (out[i - step], int(above[i - step])) if i >= step else (left[i], corner[i])
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            near = (abs(p - a), abs(p - b), abs(p - c))
            guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def write_png(levels: np.ndarray, depth: int = 8, palette: np.ndarray | None = None) -> bytes:
    """A grey PNG of 4 or 8 bits, or with a palette (n, 3) one of its indexes."""
    height, width = levels.shape
    if depth == 4:
        even = np.pad(levels, ((0, 0), (0, width % 2))).astype(np.uint8)
        levels = even[:, ::2] << 4 | even[:, 1::2]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), levels.astype(np.uint8)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, depth, 3 if palette is not None else 0, 0, 0, 0)
    colours = _chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return PNG_MARK + _chunk(b"IHDR", head) + colours + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + _chunk(b"IEND", b"")


def grey(page: np.ndarray) -> np.ndarray:
    """A page over white, as luma of 0..255."""
    a = page.astype(np.float32)
    if a.shape[2] in (2, 4):
        alpha = a[..., -1:] / 255
        a = a[..., :-1] * alpha + 255 * (1 - alpha)
    return a[..., 0] if a.shape[2] == 1 else a @ np.array([0.299, 0.587, 0.114], np.float32)


def edge_lines(luma: np.ndarray, threshold: int = 40) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) lines of ink at the very edge, at most four a side, where it is clear inside of them."""
    ink = luma < 255 - threshold
    if min(ink.shape) <= 2 * LINE_LOOK:
        return (0, 0, 0, 0)

    def lines(side: np.ndarray) -> int:
        share = side[: LINE_MOST + LINE_LOOK].mean(axis=1)
        n = int(np.logical_and.accumulate(share[:LINE_MOST] > LINE_INK).sum())
        return n * bool(share[n : n + LINE_LOOK].mean() <= LINE_CLEAR)

    return lines(ink.T), lines(ink), lines(ink.T[::-1]), lines(ink[::-1])


def dark_sides(luma: np.ndarray) -> tuple[bool, bool, bool, bool]:
    """Whether the two outermost lines of (left, top, right, bottom) are dark and even."""
    told = [np.percentile(part, (25, 50, 75)) for part in (luma[:, :2], luma[:2], luma[:, -2:], luma[-2:])]
    return tuple(bool(q[2] - q[0] <= FLAT_SPREAD and q[1] < MIDDLE) for q in told)


def content_box(luma: np.ndarray, threshold: int = 40, window: int = 3, most: float = 0.3) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of what isn't the page's ground: ink that most of its window has too, with two pixels about it; the whole page if more than `most` of a side would go."""
    height, width = luma.shape
    ground = np.median(np.concatenate((luma[:, :2].ravel(), luma[:, -2:].ravel(), luma[:2].ravel(), luma[-2:].ravel())))
    far = np.abs(luma - ground) > threshold
    total = np.pad(far.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    half = window // 2
    y0, y1 = np.clip(np.arange(height) - half, 0, None), np.clip(np.arange(height) + half + 1, None, height)
    x0, x1 = np.clip(np.arange(width) - half, 0, None), np.clip(np.arange(width) + half + 1, None, width)
    held = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    keep = held * 2 > window * window
    ys, xs = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
    if not len(ys):
        return 0, 0, width, height
    box = max(0, xs[0] - half - 2), max(0, ys[0] - half - 2), min(width, xs[-1] + half + 3), min(height, ys[-1] + half + 3)
    if (box[2] - box[0]) < (1 - most) * width or (box[3] - box[1]) < (1 - most) * height:
        return 0, 0, width, height
    return tuple(int(v) for v in box)


def scaled(luma: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means where it shrinks, linear between pixels where it grows."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        m = len(a)
        if n == m:
            return a
        if n < m:
            edges = np.arange(n + 1) * m / n
            total = np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)))
            low = np.minimum(edges.astype(int), m - 1)
            at = total[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
            return np.diff(at, axis=0) * n / m
        place = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(place.astype(int), max(0, m - 2))
        part = (place - low).reshape(-1, *[1] * (a.ndim - 1))
        return a[low] * (1 - part) + a[np.minimum(low + 1, m - 1)] * part

    return along(along(luma, height).T, width).T


def sharpened(luma: np.ndarray, amount: float, sigma: float = 1.0) -> np.ndarray:
    """Unsharp mask by a separable Gaussian."""
    if amount <= 0:
        return luma
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    blur = luma
    for axis in (0, 1):
        pad = [(reach, reach) if i == axis else (0, 0) for i in (0, 1)]
        wide = np.pad(blur, pad, mode="edge")
        blur = sum(k * np.take(wide, np.arange(i, i + blur.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return np.clip(luma + amount * (luma - blur), 0, 255)


def tone_table(black: float, white: float, gamma: float) -> np.ndarray:
    """Levels, then gamma, of the 256 shades."""
    v = np.clip((np.arange(256) - black) * 255 / max(1e-3, white - black), 0, 255)
    return (v / 255) ** (1 / gamma) * 255


def quantised(luma: np.ndarray, dither: bool = True) -> np.ndarray:
    """Sixteen levels, rounded, or by the thresholds of the ordered matrix."""
    if not dither:
        return np.clip(np.rint(luma / 17), 0, 15).astype(np.uint8)
    t = np.array(bayer()).reshape(8, 8)
    tiled = np.tile(t, (-(-luma.shape[0] // 8), -(-luma.shape[1] // 8)))[: luma.shape[0], : luma.shape[1]]
    return np.clip(np.rint((luma + (tiled - 0.5) * 17) / 17), 0, 15).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The mean product of two pages' standard scores on a grid of 72 x 96."""
    z = [(g - g.mean()) / (g.std() + 1e-6) for g in (scaled(a, 72, 96), scaled(b, 72, 96))]
    return float((z[0] * z[1]).mean())
