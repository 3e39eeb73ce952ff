"""Profiles of devices: read from TOML, inherited from bases, checked by rules that are all reported at once."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.lineage import cut_lineage

RAW = "name string, base string, is_mixin boolean, field string, value string"

# What a field may be, as (field, condition over its name).
RULES = (
    ("descreen_strength", "between 0 and 1"), ("descreen_peaks", "between 0 and 64"), ("descreen_peak_ratio", ">= 1"), ("descreen_min_amplitude", ">= 0"), ("descreen_deadband", ">= 0"),
    ("defringe_strength", "between 0 and 1"), ("defringe_deadband", ">= 0"), ("usm_amount", ">= 0"), ("autocrop_max_frac", "between 0 and 1"), ("mono_chroma_threshold", ">= 0"), ("gamma", "> 0"),
    ("jpeg_quality", "between 1 and 100"), ("webp_quality", "between 1 and 100"), ("webp_effort", "between 0 and 6"), ("png_effort", "between 1 and 10"), ("palette_colours", "between 2 and 256"),
    ("png_compression", "between 0 and 9"), ("saturation", ">= 0"), ("chroma_ratio", "between 0.1 and 1"), ("chroma_blur", "between 0 and 10"),
    ("defringe_angle", ">= 0"), ("upscale_max", "between 1 and 8"), ("strip_scale_max", "between 1 and 8"), ("descreen_max_megapixels", "<= 64"), ("usm_sigma", "<= 10"), ("autocrop_threshold", "between 0 and 254"),
)
# Open bounds, as (field, above, below); and rules over two fields, as (fields named, what must hold).
OPEN_BOUNDS = (("descreen_width", 0, 0.5), ("descreen_min_freq", 0, 0.5), ("defringe_min_freq", 0, 0.5), ("defringe_tolerance", 0, None), ("descreen_max_megapixels", 0, None), ("usm_sigma", 0, None))
CROSS_RULES = (
    ("black, white", ("black", "white"), "0 <= black and black < white and white <= 255"),
    ("defringe, panel", ("defringe", "panel"), "defringe = 'none' or panel = 'kaleido'"),
    ("width, height", ("width", "height", "fmt"), "fmt = 'raw' or (width > 0 and height > 0)"),
    ("defringe_tolerance", ("defringe_tolerance",), "defringe_tolerance <= 45"),
    ("defringe_angle", ("defringe_angle",), "defringe_angle < 360"),
)
CHOICES = (("auto_mono_fmt", ("png4", "png8")),)


def read_toml(spark: SparkSession, text: str) -> DataFrame:
    """Rows of RAW from one TOML text with the sections `profiles` and `mixins`; a small file of settings, read by the driver."""
    data = tomllib.loads(text)
    other, both = sorted(set(data) - {"profiles", "mixins"}), sorted(set(data.get("profiles", {})) & set(data.get("mixins", {})))
    if other or both:
        raise ValueError(f"sections that aren't known: {other}; names that are both a profile and a mixin: {both}")
    rows = []
    for section, is_mixin in (("profiles", False), ("mixins", True)):
        for name, fields in data.get(section, {}).items():
            own = {k: v for k, v in fields.items() if k != "base"} or {None: None}
            rows += [(name, fields.get("base"), is_mixin, k, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in own.items()]
    return spark.createDataFrame(rows, RAW)


def _bases(raw: DataFrame) -> DataFrame:
    return cut_lineage(raw.groupBy("name").agg(F.max("base").alias("base")))


def _climbed(own: DataFrame, rows: DataFrame, keys: list[str], value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`rows` (name, keys, value, depth) of each name of `own` (name, base) and of all its bases, the nearest of each key; and the names whose chains never end.

    Each round doubles how far up a name has looked, so rounds go with the logarithm of the longest chain. Only names that are in a cycle or lead to one are left in the end.
    """
    base_of = own.where("base is not null").select("name", F.col("base").alias("to"))
    up, step, before = cut_lineage(base_of.join(own.select(F.col("name").alias("to")), "to", "left_semi")), 1, None
    nearest = [] if value is None else [F.min_by(value, "depth").alias(value)]
    while (left := up.count()) and not (left == before and step >= left):
        above = up.join(rows.withColumnRenamed("name", "to"), "to").withColumn("depth", (F.col("depth") + step).cast("int")).select(rows.columns)
        rows = cut_lineage(rows.union(above).groupBy("name", *keys).agg(*nearest, F.min("depth").alias("depth")).select(rows.columns))
        up = cut_lineage(up.join(up.select(F.col("name").alias("to"), F.col("to").alias("_next")), "to").select("name", F.col("_next").alias("to")))
        step, before = 2 * step, left
    return rows, up.select("name")


def _ancestors(own: DataFrame) -> DataFrame:
    pairs = _climbed(own, own.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth")), ["ancestor"])[0]
    last = F.max("depth").over(Window.partitionBy("name"))
    bases = own.select(F.col("name").alias("ancestor"), F.col("base").alias("_base"))
    known = own.select(F.col("name").alias("_base"), F.lit(True).alias("_known"))
    told = pairs.withColumn("_last", last).join(bases, "ancestor").join(known, "_base", "left")
    return told.select("name", "ancestor", "depth", F.when(F.col("_base").isNull(), None).when(F.col("_known").isNull(), "unknown base").when(F.col("depth") == F.col("_last"), "cycle").alias("problem"))


def ancestry(raw: DataFrame) -> DataFrame:
    """(name, ancestor, depth, problem): each name, itself at depth 0, then its bases, however many; a cycle or an unknown base ends the chain and is told."""
    return _ancestors(_bases(raw))


def chains(raw: DataFrame) -> DataFrame:
    """(name, depth, problem): how long each name's chain is and what ends it before its root, as ancestry() tells it; one row a name all the way."""
    own = _bases(raw)
    ended = own.where("base is null").select("name", F.lit("root").alias("end"), F.lit(None).cast("string").alias("problem"), F.lit(0).alias("depth"))
    unknown = own.where("base is not null").join(own.select(F.col("name").alias("base")), "base", "left_anti")
    ended = ended.union(unknown.select("name", F.lit("root"), F.lit("unknown base"), F.lit(0)))
    rows, endless = _climbed(own, ended, ["end"], "problem")
    # What is in a cycle or leads to one: its bases are too, so these chains are looked at by themselves.
    cyclic = _ancestors(cut_lineage(own.join(endless, "name", "left_semi")))
    return rows.select("name", "depth", "problem").union(cyclic.groupBy("name").agg(F.max("depth").alias("depth"), F.max("problem").alias("problem")))


def inherited(raw: DataFrame) -> DataFrame:
    """(name, field, value): every field of a profile, its own value before its bases', the nearest base first. Mixins are no profiles."""
    fields = raw.where("field is not null").groupBy("name", "field").agg(F.min("value").alias("value")).withColumn("depth", F.lit(0))
    names = raw.where("not is_mixin").select("name").distinct()
    return _climbed(_bases(raw), cut_lineage(fields), ["field"], "value")[0].join(names, "name", "left_semi").select("name", "field", "value")


def problems(columns: list[str]) -> Column:
    """The names of the fields, of those in `columns` that have a rule, whose values break it; a null value breaks none."""
    broken = [F.when(~F.expr(f"`{f}` {rule}"), F.lit(f)) for f, rule in RULES if f in columns]
    broken += [F.when(~((F.col(f) > low) & (F.lit(True) if high is None else F.col(f) < high)), F.lit(f)) for f, low, high in OPEN_BOUNDS if f in columns]
    broken += [F.when(~F.expr(rule), F.lit(named)) for named, needed, rule in CROSS_RULES if set(needed) <= set(columns)]
    broken += [F.when(~F.col(f).isin(*of), F.lit(f)) for f, of in CHOICES if f in columns]
    return F.array_distinct(F.array_compact(F.array(*broken))) if broken else F.array().cast("array<string>")
