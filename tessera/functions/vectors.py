"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; null vectors give null."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def strict_dot(a: Column, b: Column) -> Column:
    """Dot product that is the least single-precision number where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.lit(-3.4028234663852886e38))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; vectors of length up to 1e-6 stay as they are."""
    return let(norm(a), lambda n: F.when(n > 1e-6, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>")))


def rounded(x: Column, digits: int = 6) -> Column:
    """``x`` rounded, halves away from zero; what rounds to zero keeps its sign, as in SQL engines other than Spark."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def weighted_mean(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Normalised mean of two centroids weighted by their sizes."""
    total = F.nullif(n_a + n_b, F.lit(0))
    return normalised(F.zip_with(a, b, lambda x, y: (x * n_a + y * n_b) / total))
