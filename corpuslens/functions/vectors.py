"""Array arithmetic on dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(a)
    scaled = F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]
    return F.when(length > 0, scaled).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when one vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)
