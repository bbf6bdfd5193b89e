"""Vector math on ``array<float>`` columns with higher-order functions.

Spark 4.1 has no built-in cosine; these stay JVM-side (codegen'd lambdas),
accumulate in double, and return NULL for a zero norm (``try_divide``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """dot / (|a| |b|); pass precomputed norms to make it one dot product."""
    na = norm_a if norm_a is not None else norm(a)
    nb = norm_b if norm_b is not None else norm(b)
    return F.try_divide(dot(a, b), na * nb)


def scale(a, s: Column) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double") * s)


def normalize(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.try_divide(x.cast("double"), n))
