"""Aggregates with the rules that page timings and image margins need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_rank(values: Column, share: float) -> Column:
    """The element of the sorted values at floor(share * n), the last at most; no interpolation. For bounded groups."""
    kept = F.sort_array(F.collect_list(values))
    return F.element_at(kept, F.least(F.size(kept), F.floor(F.size(kept) * share).cast("int") + 1))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tone(v: Column, black: float, white: float, gamma: float, top: float = 255.0) -> Column:
    """Levels, then gamma, on a scale up to `top`."""
    return F.pow(clamp((v - black) / (white - black), 0.0, 1.0), F.lit(1 / gamma)) * top


def sixteen_levels(v: Column) -> Column:
    return clamp(F.rint(v / 17), 0.0, 15.0).cast("int")
