"""Titles and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.uris import base_name, extension, without_extension


def title_key(name: Column, drop_punctuation: bool = False) -> Column:
    """The title without extension, bracketed parts and white space, lower case; also without other punctuation, if asked."""
    x = without_extension(name)
    for pattern in (r"\[[^\[\]]+\]", r"\([^\(\)]+\)", r"\{.*?\}"):
        x = F.regexp_replace(x, pattern, "")
    if drop_punctuation:
        x = F.regexp_replace(x, r"(?U)[^\w\s\-]", "")
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


def group_tag(name: Column, word: str = "汉化") -> Column:
    """What the first bracketed part with `word` says; empty without one."""
    return F.regexp_extract(without_extension(name), rf"\[([^\]]*?{word}.*?)\]", 1)


def version(stem: Column) -> Column:
    """The number N of a `vN` that ends a title, or stands before a bracket that ends it; null without one."""
    return F.regexp_extract(stem, r"(?i)v(\d+)[)\]]?$", 1).try_cast("int")


def without_version(stem: Column) -> Column:
    """The title without a final `vN` that a space, `_`, `-` or bracket sets off."""
    return F.regexp_replace(F.regexp_replace(stem, r"(?iU)[\s_\-(\[]v\d+[)\]]?$", ""), r"(?U)\s+$", "")


def without_hash_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"\[hash-[0-9a-fA-F]+\]", "")


def hash_in_name(name: Column) -> Column:
    """The hash that a `[hash-...]` tag holds; null without one."""
    h = F.regexp_extract(name, r"\[hash-([^\]]*)\]", 1)
    return F.when(h != "", h)


def with_language_suffix(name: Column, suffix: Column) -> Column:
    stem = F.substr(base_name(name), F.lit(1), F.length(base_name(name)) - F.length(extension(name)))
    return F.when(stem.endswith(suffix), name).otherwise(F.concat(without_extension(name), suffix, F.substr(name, F.length(without_extension(name)) + 1)))


def metric_tag(width: Column, pages: Column, clarity: Column) -> Column:
    """`{1.8k@WD,120@PX,3.2k@DE}` of the metrics above 0; empty without any."""
    part = lambda c, unit: F.when(c > 0, F.concat(short_number(c), F.lit(unit)))
    inner = F.concat_ws(",", part(width, "@WD"), part(pages, "@PX"), part(clarity, "@DE"))
    return F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise("")


def metrics_of(name: Column) -> Column:
    """struct<width, pages, clarity> of a metric tag; shortened or missing values are 0."""
    get = lambda unit, kind: F.coalesce(F.regexp_extract(name, rf"([^,{{}}]*)@{unit}", 1).try_cast(kind), F.lit(0).cast(kind))
    return F.struct(get("WD", "int").alias("width"), get("PX", "int").alias("pages"), get("DE", "double").alias("clarity"))


def without_metric_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"\{[^}]*@(?:PX|WD|DE)[^}]*\}", "")


def width_in_name(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"\[(\d+)px\]", 1).try_cast("int"), F.lit(0))


def pages_in_name(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"\{(\d+)@PX\}", 1).try_cast("int"), F.lit(0))


def short_number(number: Column, precision: int = 1, by_ten_thousands: bool = True) -> Column:
    """Numbers from 1000 on in k, w and 亿, or in k, M and B; the fraction goes where it is nothing. Halves round to even."""
    n = F.bround(number.cast("double"), 0).cast("long")
    steps = [(100_000_000, "亿"), (10_000, "w"), (1000, "k")] if by_ten_thousands else [(1_000_000_000, "B"), (1_000_000, "M"), (1000, "k")]
    out = n.cast("string")
    for least, unit in reversed(steps):
        digits = F.bround(n / least, precision)
        text = F.when(n % least == 0, F.expr("cast(1 as bigint)") * F.floor(n / least)).cast("string")
        text = F.coalesce(text, F.format_string(f"%.{precision}f", digits))
        out = F.when(n >= least, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def file_size(size: Column) -> Column:
    """Bytes as B, or with one decimal as KB, MB or GB."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for least, unit in ((1024, "KB"), (1024**2, "MB"), (1024**3, "GB")):
        out = F.when(size >= least, F.format_string(f"%.1f {unit}", size / F.lit(float(least)))).otherwise(out)
    return out


def size_difference(more: Column, less: Column) -> Column:
    d = more - less
    return (
        F.when(d > 1024**2, F.format_string("%.2f MB smaller", d / F.lit(float(1024**2))))
        .when(d > 1024, F.format_string("%.2f KB smaller", d / F.lit(1024.0)))
        .otherwise(F.concat(d.cast("long").cast("string"), F.lit(" bytes smaller")))
    )


def distance_class(distance: Column) -> Column:
    return F.when(distance <= 5, "low").when(distance <= 15, "medium").otherwise("high")


def numbered(name: Column, n: Column) -> Column:
    """`name` for 0, `stem_n.ext` beyond."""
    stem = without_extension(name)
    return F.when(n > 0, F.concat(stem, F.lit("_"), n.cast("string"), F.substr(name, F.length(stem) + 1))).otherwise(name)
