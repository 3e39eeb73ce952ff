"""Where a reader is: places in the source book and in the one that was made of it; and what is kept about both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.links import is_digest


def to_source(pages: Column, page: Column) -> Column:
    """The source page of an output page; `pages`: the source page of each output page. Without any, the page itself."""
    at = F.greatest(F.lit(1), F.least(page, F.size(pages)))
    return F.when(F.size(pages) == 0, page).otherwise(F.greatest(F.lit(1).cast("long"), F.get(pages, (at - 1).cast("int")).cast("long")))


def from_source(pages: Column, page: Column) -> Column:
    """The first output page of a source page, or else the last one before it; at least the first."""
    before = F.size(F.filter(pages, lambda p: p < page))
    return F.when(F.size(pages) == 0, page).when(F.array_contains(pages, page), before + 1).otherwise(F.greatest(before, F.lit(1)))


def shown_page(pages: Column, pushed: Column, source: Column) -> Column:
    """The output page for a source page: that which was pushed for it last (struct<page, source>), else by from_source()."""
    return F.when(pushed["source"] == source, pushed["page"]).otherwise(from_source(pages, source))


def valid_lineage(record: Column) -> Column:
    """struct<source, pages> of a record as JSON, or null: a legal digest and a list of whole numbers that isn't empty."""
    node = F.try_parse_json(record)
    pages, digest = F.try_variant_get(node, "$.pages", "array<variant>"), F.try_variant_get(node, "$.source", "string")
    whole = F.forall(pages, lambda p: F.schema_of_variant(p) == "BIGINT")
    return F.when(is_digest(digest) & (F.size(pages) > 0) & whole, F.struct(digest.alias("source"), F.try_variant_get(node, "$.pages", "array<int>").alias("pages")))
