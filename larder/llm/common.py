"""Helpers shared by the operators of this package.

Conventions every operator follows, unless its docstring says otherwise:

* only the columns it needs are selected from its input, so extra columns,
  whatever their names, never clash with working columns;
* a null text counts as the empty text; an empty table gives an empty result;
* rows that repeat a ``doc_id`` are documents of their own unless stated.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

#: Fixed value: what separates words (space, tab, line feed, vertical tab, form feed, return).
SPACES = r"[\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order: what lies between runs of ``SPACES``."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/larder-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    and a lost executor costs nothing that was computed before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more. Shuffle files
    go when Spark's cleaner finds their frames unreachable, so both collectors
    are asked to look."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/larder-llm/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def only(df: DataFrame, flag: Column) -> DataFrame:
    """The rows for which ``flag`` holds. A filter would be pushed below the
    projections that compute it, with a copy of every expression on the way;
    it stays above a generated column."""
    return df.withColumn("_flag", F.explode(F.array(flag))).where("_flag").drop("_flag")


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, row_id: str, name: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows up to this one, itself
    included, in the total order ``order``; ``row_id``: an id of the row that
    ascends in that order. Adds both columns.

    No task sees more than its range: rows are range-partitioned and written
    with their partition number, a partition's offset is the sum of the
    partitions before it (one row per partition, the only unpartitioned
    window), and the sum inside a partition is a window over that partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("_pid", F.spark_partition_id()).withColumn(row_id, F.monotonically_increasing_id()), name)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (laid.groupBy("_pid").agg(F.sum(value).alias("_sum"))
               .select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    here = Window.partitionBy("_pid").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    return (laid.withColumn("_in", F.sum(value).over(here))
            .join(F.broadcast(offsets), "_pid")  # one row per partition
            .withColumn(out, F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before"))
