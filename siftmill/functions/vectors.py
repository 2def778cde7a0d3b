"""Vector similarities as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null, zero, or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def scaled_euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), 1 / (1 + F.sqrt(dot(d, d))))
