"""Text columns: natural order, tokens, sizes, durations, notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of page images, and names that archives hold beside pages.
IMAGE_SUFFIXES = ("avif", "bmp", "gif", "hdp", "j2k", "jb2", "jbig2", "jp2", "jpeg", "jpg", "jpx", "jxl", "jxr", "pam", "pbm", "pgm", "pkm", "png", "pnm", "ppm", "psd", "tif", "tiff", "wdp", "webp")
JUNK_NAMES = ("__macosx", "thumbs.db", "ehthumbs.db", "desktop.ini")


def natural_key(name: Column) -> Column:
    """Runs of digits compare as numbers, other runs as lower-case text. Digits too long for a number compare by length, then as text."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.struct(F.lit("").alias("text"), F.length(digits(r)).alias("digits"), digits(r).alias("number"))).otherwise(F.struct(r.alias("text"), F.lit(0).alias("digits"), F.lit("").alias("number"))))


def is_junk(path: Column) -> Column:
    """Any part of the path is hidden or a system file; both slashes part. `.` and `..` are no names."""
    return F.exists(F.split(F.lower(path), r"[\\/]"), lambda p: (p.startswith(".") & ~p.isin(".", "..")) | p.isin(*JUNK_NAMES))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$") & ~F.element_at(F.split(path, "/"), -1).startswith(".")


def encode_token(text: Column) -> Column:
    """URL-safe base64 without padding or line breaks."""
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def decode_token(token: Column) -> Column:
    return F.decode(F.unbase64(F.concat(F.translate(token, "-_", "+/"), F.expr("repeat('=', 3)").substr(F.lit(1), (4 - F.length(token) % 4) % 4))), "UTF-8")


def human_bytes(n: Column) -> Column:
    """Tenths are rounded in whole numbers: a half, which is exact here, goes to the even tenth."""
    n = n.cast("double").cast("long")

    def tenths(unit: int) -> Column:
        over = n % unit * 10
        rest = over % unit * 2
        down = F.floor(n / unit) * 10 + F.floor(over / unit)
        t = down + F.when((rest > unit) | ((rest == unit) & (down % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(tenths(1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(tenths(1024**2), F.lit(" MB")))
        .otherwise(F.concat(tenths(1024**3), F.lit(" GB")))
    )


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    part = lambda unit: F.floor(s / unit).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(part(60), F.lit(" min"))).when(s < 86400, F.concat(part(3600), F.lit(" h"))).otherwise(F.concat(part(86400), F.lit(" d")))


def note(text: Column, most: int = 140) -> Column:
    """White space collapsed; what is longer than `most` characters ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)
