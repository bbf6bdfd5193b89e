"""Data-quality checks (Q1-Q3), plus the sentinel list parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dq_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q1: key values that occur more than once, with their count
    (partial aggregation, so a hot key is combined map-side)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).cast("long").alias("n"))
            .where(F.col("n") > 1))


def dq_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q2: number of NULLs per column, one row per column (one scan)."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).cast("long").alias(c) for c in cols])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols]))
    return counts.select(stacked.alias("s")).select("s.column_name", "s.null_count")


def dq_foreign_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Q3: child rows whose key has no parent (anti join)."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(p, child_key, "left_anti")


# The list sentinels that mean "no entries".
LIST_SENTINELS = ["None", "Any"]


def sentinel_list_parse(text: Column, allowed: list[str]) -> Column:
    """Comma list, trimmed; a sentinel gives an empty list; only
    allowed values are kept (in input order, duplicates removed)."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    kept = F.filter(items, lambda x: x.isin(*allowed))
    is_sentinel = F.trim(F.coalesce(text, F.lit(""))).isin(*LIST_SENTINELS)
    return F.when(is_sentinel, F.array().cast("array<string>")).otherwise(F.array_distinct(kept))
