"""Mixing sources to target weights: iterative proportional fitting over the table of cells, then sampling by calibrated probability.

DataFrame operations only. The cells (combinations of the marginal columns' values) are few; documents are read twice, once
to sum their tokens by cell and once to draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SWEEPS = 12


def fit(cells: DataFrame, margins: dict[str, dict[str, float] | None], sweeps: int = SWEEPS) -> DataFrame:
    """`cells` (the margin columns, tokens) with `weight`: tokens raked to the target share of every margin.

    A margin without targets (None) gives each of its values the same share. Values without a target share what the named ones
    leave of 1, in proportion to their tokens; where those leave nothing, they keep the share of the tokens that they have.
    Targets of absent values are spread over the present ones. Nulls are values. Cells stay zero where there are no tokens.
    """
    whole = Window.partitionBy(F.lit(0))
    goals = cells.withColumn("_all", F.sum("tokens").over(whole))
    for name, wanted in margins.items():
        over = Window.partitionBy(name)
        has = f"_has_{name}"
        goals = goals.withColumn(has, F.sum("tokens").over(over))
        if wanted is None:
            raw = F.lit(1.0)
        elif wanted:
            named = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
            raw = F.try_element_at(named, F.coalesce(F.col(name).cast("string"), F.lit("")))
        else:
            raw = F.lit(None).cast("double")
        goals = goals.withColumn(f"_raw_{name}", raw)
        rest = 1.0 - sum((wanted or {}).values())
        others = F.sum(F.when(F.col(f"_raw_{name}").isNull(), F.col("tokens"))).over(whole)
        if rest > 1e-9:
            left = F.lit(rest)
        else:  # as much beside the named ones that are present as their tokens are beside those
            present = F.sum(F.col(f"_raw_{name}") * F.col("tokens") / F.col(has)).over(whole)
            left = F.coalesce(F.try_divide(present * others, F.col("_all") - others), F.lit(1.0))
        goals = goals.withColumn(f"_raw_{name}", F.coalesce(F.col(f"_raw_{name}"), left * F.col(has) / others))
        share = F.sum(F.col(f"_raw_{name}") * F.col("tokens") / F.col(f"_has_{name}")).over(whole)
        goals = goals.withColumn(f"_goal_{name}", F.col(f"_raw_{name}") / share * F.col("_all"))
    fitted = goals.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(sweeps):
        for name in margins:
            fitted = fitted.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_goal_{name}"), F.sum("weight").over(Window.partitionBy(name))), F.lit(0.0)))
        if sweep % 4 == 3:  # keeps the plan short
            fitted = write_table(fitted, "raked")
    return fitted.select(*margins, "tokens", "weight")


def unit_draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone, and is the same in any engine: 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, margins: dict[str, dict[str, float] | None], tokens: Column, seed: str = "mix") -> DataFrame:
    """`docs` with `tokens`, `probability`, `draw` and `kept`, in place of columns of those names.

    The probability of a cell is its raked weight over its tokens, scaled so that the largest is 1: the sample has the
    target shares in expectation and is as large as they allow. A cell without tokens (empty texts) is kept whole. Rows
    that repeat a doc_id are drawn alike. No rows: none.
    """
    sized = docs.withColumn("tokens", tokens)
    cells = write_table(sized.groupBy(*margins).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = fit(cells.where("tokens > 0"), margins)
    ratio = fitted.select(*[F.col(n).alias(f"_cell_{n}") for n in margins], (F.col("weight") / F.col("tokens")).alias("_ratio"))
    ratio = write_table(ratio.withColumn("_probability", F.col("_ratio") / F.max("_ratio").over(Window.partitionBy(F.lit(0)))), "ratios")
    same = [F.col(n).eqNullSafe(F.col(f"_cell_{n}")) for n in margins]
    on = same[0]
    for s in same[1:]:
        on &= s
    drawn = sized.join(ratio, on, "left").withColumn("probability", F.coalesce("_probability", F.lit(1.0))).withColumn("draw", unit_draw(F.col("doc_id"), seed))
    return drawn.withColumn("kept", F.col("draw") < F.col("probability")).drop("_ratio", "_probability", *[f"_cell_{n}" for n in margins])
