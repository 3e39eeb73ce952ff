"""Pages for a panel: decoded, cropped, scaled, padded, toned and quantised, one narrow pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.functions import pixels


@dataclass(frozen=True)
class Panel:
    """The size of a screen and how pages are made for it. `upscale`: how far small pages grow."""

    width: int = 1264
    height: int = 1680
    upscale: float = 2.0
    crop: bool = True
    black: float = 0.0
    white: float = 255.0
    gamma: float = 1.0
    sharpen: float = 0.0
    dither: bool = True

    def narrowed(self, most: int) -> Panel:
        """The panel for a request that wants at most so wide a page; the height keeps the proportion. 0: as it is."""
        if not 0 < most < self.width:
            return self
        return Panel(**{**self.__dict__, "width": most, "height": max(1, round(self.height * most / self.width))})


def image_sizes(df: DataFrame, content: str) -> DataFrame:
    """`df` with `size` (struct<width, height>): by the first 32 KiB of PNG, GIF and JPEG; null of what can't be told. Bodies don't reach Python."""

    def told(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pixels.head_size(h) or (None, None) for h in heads], columns=["width", "height"]).astype("Int32")

    size = F.pandas_udf(told, "width int, height int")(F.substring(content, 1, 32768))
    known = df.withColumn("_size", size)
    return known.withColumn("size", F.when(F.col("_size.width").isNotNull(), F.col("_size"))).drop("_size")


def render(luma: np.ndarray, panel: Panel) -> tuple[bytes, tuple[int, int, int, int]]:
    """(PNG of sixteen levels, (x, y, width, height) of the page on the panel)."""
    if panel.crop:
        left, top, right, bottom = pixels.edge_lines(luma)
        luma = luma[top : luma.shape[0] - bottom, left : luma.shape[1] - right]
        x0, y0, x1, y1 = pixels.content_box(luma)
        luma = luma[y0:y1, x0:x1]
    factor = min(panel.width / luma.shape[1], panel.height / luma.shape[0])
    factor = min(factor, panel.upscale) if factor > 1.005 else factor
    w, h = (max(1, min(most, round(n * factor))) for n, most in ((luma.shape[1], panel.width), (luma.shape[0], panel.height)))
    page = pixels.sharpened(pixels.scaled(luma, w, h), panel.sharpen)
    ground = 255.0 if sum(pixels.dark_sides(luma)) < 3 else 0.0
    table = pixels.tone_table(panel.black, panel.white, panel.gamma)
    x, y = (panel.width - w) // 2, (panel.height - h) // 2
    out = np.full((panel.height, panel.width), 15 if ground else 0, np.uint8)
    out[y : y + h, x : x + w] = pixels.quantised(table[np.clip(np.rint(page), 0, 255).astype(np.uint8)], panel.dither)
    return pixels.write_png(out, 4), (x, y, w, h)


def render_pages(df: DataFrame, content: str, panel: Panel, most_width: Column | None = None) -> DataFrame:
    """`df` with `page` (PNG of 4 bits), `x`, `y`, `w`, `h` (where the picture is on it) and `problem`: why a page was not made, its bytes passed on as they are.

    One row is one page; rows are independent, so nothing is shuffled and a lost task costs its own pages. `most_width`: of each request, 0 for none.
    """
    added = StructType.fromDDL("page binary, x int, y int, w int, h int, problem string")
    rows = df.withColumn("_most", F.coalesce(most_width, F.lit(0)).cast("int") if most_width is not None else F.lit(0))

    def made(data: bytes | None, most: int) -> tuple:
        page = pixels.read_png(data) if data else None
        if page is None or not page.size:
            return (data, None, None, None, None, "unreadable")
        png, place = render(pixels.grey(page), panel.narrowed(most))
        return (png, *place, None)

    def run(batches):
        for b in batches:
            new = pd.DataFrame([made(d, m) for d, m in zip(b[content], b["_most"])], columns=added.names, index=b.index)
            new[["x", "y", "w", "h"]] = new[["x", "y", "w", "h"]].astype("Int32")
            yield pd.concat((b.drop(columns="_most"), new), axis=1)

    return rows.mapInPandas(run, StructType([*df.schema.fields, *added.fields]))


def differing_covers(pairs: DataFrame, cover: str, first: str, most: float = 0.85) -> DataFrame:
    """`pairs` with `needed`: the cover is another picture than the first page (or one of them can't be read)."""

    def told(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [(pixels.read_png(x) if x else None, pixels.read_png(y) if y else None) for x, y in zip(a, b)]
        return pd.Series([x is not None and (y is None or pixels.likeness(pixels.grey(x), pixels.grey(y)) <= most) for x, y in both])

    return pairs.withColumn("needed", F.pandas_udf(told, "boolean")(cover, first))
