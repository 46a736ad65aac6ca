"""Vector distances and scores as expressions; elements are doubles before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


METRICS = {"squared_l2": squared_l2, "l2": lambda a, b: F.sqrt(squared_l2(a, b)), "cosine": cosine_distance}


def score(distance: Column) -> Column:
    """1 at distance 0; a missing distance counts as 0."""
    return F.sqrt(F.exp(-F.coalesce(distance, F.lit(0.0)) / 2))


def confidence(s: Column) -> Column:
    """NaN is low."""
    return F.when(F.isnan(s) | s.isNull(), "low").when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low")


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
