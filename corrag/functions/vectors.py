"""Vector arithmetic on array columns, for per-row work inside generated code.

Search over many vectors uses the blocked kernel in ``operators.search`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm == 0, _doubles(v)).otherwise(
        F.transform(_doubles(v), lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """0 for different dimensions or a zero vector."""
    norms = l2_norm(a) * l2_norm(b)
    return (F.when(F.size(a) != F.size(b), F.lit(0.0))
            .when(norms == 0, F.lit(0.0))
            .otherwise(dot(a, b) / norms))
