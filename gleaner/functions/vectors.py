"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-12  # below this length a vector has no direction


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a vector has no direction."""
    na, nb = norm(a), norm(b)
    fits = (F.size(a) == F.size(b)) & (na >= ZERO_NORM) & (nb >= ZERO_NORM)
    return F.when(fits, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)
