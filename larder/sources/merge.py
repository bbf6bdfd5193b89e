"""Copy-on-write merges into a table of hash partitions.

The table is a folder partitioned by a hash of its key. An update reads and
rewrites the partitions that its keys fall in and no other (dynamic partition
overwrite), so its cost follows the update, not the table. A merge that stops
half way and runs again gives the same table: rows are replaced by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


class MergeTable:
    """Rows with the unique column ``key`` in ``parts`` partitions."""

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn(PART, self.part()).repartition(self.parts, PART).write.mode("overwrite").partitionBy(PART).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def update(self, updates: DataFrame, columns: list[str], insert: bool = False) -> DataFrame:
        """Give ``columns`` of the rows with the updates' keys the new values
        (NULL keeps the old one) and return the updates that met no row; with
        ``insert`` these become rows. One update for each key."""
        fresh = updates.select(self.key, *columns).withColumn(PART, self.part())
        touched = [r[0] for r in fresh.select(PART).distinct().collect()]  # parts rows at most
        table = self.spark.read.parquet(self.path)
        old = table.where(F.col(PART).isin(touched))
        misses = updates.join(old.select(self.key), self.key, "left_anti")
        if insert:
            added = fresh.join(old.select(self.key), self.key, "left_anti")
        misses = misses.checkpoint()  # before the table changes
        new = fresh.select(F.col(self.key).alias("_k"), *[F.col(c).alias(f"_u_{c}") for c in columns])
        joined = old.join(new, F.col(self.key) == F.col("_k"), "left")
        merged = joined.select(*[(F.coalesce(F.col(f"_u_{c}"), F.col(c)) if c in columns else F.col(c)).alias(c) for c in table.columns])
        if insert:
            merged = merged.unionByName(added, allowMissingColumns=True)
        if touched:
            (merged.repartition(self.parts, PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(PART).parquet(self.path))
            self.spark.catalog.refreshByPath(self.path)
        return misses
