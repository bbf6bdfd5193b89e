"""Reader for the parquet tables of a data directory.

Only the requested columns are read, so the parquet scan prunes columns and
receives pushed filters from the plans built on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temp view (source registry, S6)."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
