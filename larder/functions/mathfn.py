"""Numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitter for doubles


def _split(a: Column) -> tuple[Column, Column]:
    t = a * F.lit(_SPLIT)
    hi = t - (t - a)
    return hi, a - hi


def pyround(x: Column, n: int) -> Column:
    """Python's ``round(x, n)`` for doubles: half-even on the exact binary value.

    Spark's ``round``/``bround`` round the shortest decimal string, so
    ``bround(144.95, 1)`` is 145.0 while Python gives 144.9 (the double is
    just below the tie). Here the product ``x * 10**n`` is formed with its
    exact rounding error (Dekker's two-product); the error decides the side
    of a tie. Pure column arithmetic, so it stays inside whole-stage codegen.
    ``x`` is referenced several times: pass a column or a cheap expression
    (compute an expensive one in an earlier projection).
    """
    c = F.lit(float(10 ** n))
    p = x * c
    xh, xl = _split(x)
    ch, cl = _split(c)
    err = ((xh * ch - p) + xh * cl + xl * ch) + xl * cl
    fl = F.floor(p).cast("double")
    frac = p - fl
    even_up = F.pmod(fl, F.lit(2.0)) == 1.0
    tie_up = F.when(err > 0, F.lit(True)).when(err < 0, F.lit(False)).otherwise(even_up)
    k = (F.when(frac > 0.5, fl + 1).when(frac < 0.5, fl)
         .otherwise(F.when(tie_up, fl + 1).otherwise(fl)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(k / c)


def pyround_sql(x: str, n: int) -> str:
    """DuckDB twin of :func:`pyround`, the same two-product arithmetic
    written as SQL (DuckDB's double -> decimal cast is not exact)."""
    c = f"{float(10 ** n)!r}::DOUBLE"
    sp = f"{_SPLIT!r}::DOUBLE"
    X = f"(({x})::DOUBLE)"
    p = f"({X} * {c})"
    xh = f"(({X} * {sp}) - (({X} * {sp}) - {X}))"
    xl = f"({X} - {xh})"
    ch = f"(({c} * {sp}) - (({c} * {sp}) - {c}))"
    cl = f"({c} - {ch})"
    err = f"((({xh} * {ch} - {p}) + {xh} * {cl} + {xl} * {ch}) + {xl} * {cl})"
    fl = f"CAST(floor({p}) AS DOUBLE)"
    frac = f"({p} - {fl})"
    tie_up = f"(CASE WHEN {err} > 0 THEN TRUE WHEN {err} < 0 THEN FALSE ELSE fmod({fl}, 2.0) = 1.0 END)"
    k = (f"(CASE WHEN {frac} > 0.5 THEN {fl} + 1 WHEN {frac} < 0.5 THEN {fl} "
         f"WHEN {tie_up} THEN {fl} + 1 ELSE {fl} END)")
    return f"(CASE WHEN {X} IS NULL OR isnan({X}) THEN {X} ELSE {k} / {c} END)"
