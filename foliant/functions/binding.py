"""A value that an expression uses many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value. Nested expressions would otherwise repeat it, and what is in it, wherever they name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
