"""Sinks: materialization and table writes.

Written intermediates go to a sub folder of the shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local path on a cluster.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.sources.manifest import Manifest


def materialize_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """S7 (table) / S9: overwrite then read back (lineage is cut)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: The table that each column of ``plan_rows`` holds rows of.
PLAN_TABLES = ["meal_plans", "daily_meals", "meal_details", "shopping_lists"]


def write_plan_tables(rows: DataFrame, base: str) -> dict[str, DataFrame]:
    """Write the rows of all plan tables in one pass and make the tables
    visible together.

    ``rows`` (``operators.plandocs.plan_rows``) has one struct column per
    table, of which one is set, and ``table``. One job writes them, a folder
    per table, under a name of its own; the manifest of ``base`` then names
    that folder. A run that fails before shows no table and leaves the tables
    of an earlier run as they were.
    """
    spark = rows.sparkSession
    manifest = Manifest(spark, base)
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy("table").parquet(f"{base}/{folder}")
    before = manifest.read()
    manifest.commit({"folder": folder, "schema": rows.drop("table").schema.json()})
    if before:
        manifest.discard(before["folder"])
    return read_plan_tables(spark, base)


def read_plan_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables that the last complete run wrote; none before the first."""
    now = Manifest(spark, base).read()
    if now is None:
        return {}
    schema = StructType.fromJson(json.loads(now["schema"])).add("table", "string")
    rows = spark.read.schema(schema).parquet(f"{base}/{now['folder']}")
    return {t: rows.where(F.col("table") == t).select(f"{t}.*") for t in PLAN_TABLES}
