"""Plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound (rows) for a side that may be broadcast after a runtime check.
BROADCAST_ROW_LIMIT = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only after checking its size; otherwise leave the join
    to the shuffle strategies (sort-merge with AQE skew handling).

    The check is a bounded count (``limit(max_rows + 1)``), so it never scans
    more than it must.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def once(c: Column) -> Column:
    """``c`` as a generated column, worked out once a row. Spark writes an
    expression out anew wherever its column is used, also in filters that it
    pushes down; it does not do so with what a generator returns. For costly
    expressions such as the parse of a document; one in a ``select``."""
    return F.explode(F.array(c))


#: Rows of a task from which on a table is spread over more tasks.
ROWS_OF_TASK = 100_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_OF_TASK) -> DataFrame:
    """``df`` hashed by ``keys`` into tasks of about ``rows`` rows, so that the
    sorts and hash tables of what follows by these keys stay as small on large
    tables. A table that fits into as few tasks as there are cores is left as
    it is. Counts the rows (of a plain table: from its file footers)."""
    spark = df.sparkSession
    n = -(-df.count() // rows)
    if n <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def global_index(df: DataFrame, order_cols: list[str], n_parts: int | None = None,
                 name: str = "row_index") -> DataFrame:
    """1-based position of each row in the total order ``order_cols``.

    No single-partition window: rows are range-partitioned on the order
    key and sorted inside each partition, and that layout is checkpointed
    once (reliable checkpoint into ``spark.checkpoint.dir``). Range bounds
    are sampled per exchange, so the positions and the per-partition counts
    must read the same materialized layout. The position inside a partition
    comes from ``monotonically_increasing_id`` (partition id in the upper
    bits); each partition's offset is a cumulative count over the
    per-partition counts (one row per partition, so that window and its
    broadcast are bounded by the partition count, not by the data).
    ``order_cols`` must be a total order (unique).
    """
    from pyspark.sql import Window
    from larder.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).checkpoint(eager=True)
    ranged = (laid_out.withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def laid_out(df: DataFrame, keys: list[str], order: list[str], n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by keys and order, checkpointed
    once, with ``_pid`` (its range) and ``_at`` (ascends within a range): the
    rows of one key, be they most of the table, are consecutive ranges."""
    from larder.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).checkpoint(eager=True)
    return laid.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())


def scanned(laid: DataFrame, keys: list[str], values: dict[str, Column], op: str, before: bool = False) -> DataFrame:
    """A segmented prefix scan over ``laid_out`` rows: columns that hold the
    ``op`` (sum or max) of ``values`` over the rows of the key up to each row,
    or up to the row ``before`` it.

    A task scans its range. A key that goes on over a border gets the result
    of its earlier ranges; only the first and last key of a range do, so
    these are two rows a range at most and are broadcast.
    """
    from pyspark.sql import Window

    fold, both = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}[op]
    names = list(values)
    laid = laid.withColumns({f"_v_{n}": c for n, c in values.items()})
    totals = laid.groupBy("_pid", *keys).agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in names])
    over = Window.partitionBy(*keys)
    earlier = over.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = (totals.withColumn("_n", F.count(F.lit(1)).over(over))
               .select(F.col("_pid").alias("_c_pid"), *[F.col(k).alias(f"_c_{k}") for k in keys], "_n", *[fold(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in names])
               .where("_n > 1").drop("_n"))
    here = Window.partitionBy("_pid", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = laid.withColumns({f"_i_{n}": fold(f"_v_{n}").over(here) for n in names})
    on = [F.col("_pid") == F.col("_c_pid"), *[F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]]
    joined = inside.join(F.broadcast(carried), on, "left")
    out = {n: both(F.col(f"_i_{n}"), F.col(f"_o_{n}")) for n in names}
    return joined.withColumns(out).drop("_c_pid", *[f"_c_{k}" for k in keys], *[f"_{x}_{n}" for n in names for x in "vio"])


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                   n_parts: int | None = None) -> DataFrame:
    """The columns ``values`` summed over the rows of a key up to each row, in
    ``order`` (a total order within a key)."""
    return scanned(laid_out(df, keys, order, n_parts), keys, {v: F.col(v) for v in values}, "sum").select(*df.columns)


#: Cells of a counting pass, and values of a bracket that are looked at one by one.
QUANTILE_CELLS, QUANTILE_ROWS = 4096, 100_000


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    tiebreak: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group (numpy/pandas
    'linear'), by selection: nothing is sorted but a few values.

    The ranks that the probabilities need lie between the group's least and
    greatest value. A counting pass divides such a bracket into cells and
    keeps the one that each rank falls in; passes go on while a bracket holds
    more than ``QUANTILE_ROWS`` rows of different values. Then the values of
    the brackets are counted, value by value, and read off. Passes are partial
    aggregates, so a group with a third of the rows is work for all tasks;
    brackets are two a probability and group.
    Output: group columns, ``q`` (probability) and ``value``; groups with a
    NULL key are left out.
    """
    from pyspark.sql import Window

    g = list(group_cols)
    base = df.select(*g, F.col(value_col).cast("double").alias("_v")).dropna()
    whole = base.groupBy(*g).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).checkpoint()
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.ceil(F.lit(float(p)) * (F.col("n") - 1))) for p in probs])))
    wanted = whole.select(*g, "lo", "hi", F.lit(0).cast("long").alias("before"), "n", F.col("n").alias("total"), F.explode(ranks).alias("r"))

    def inside(brackets: DataFrame) -> DataFrame:
        """The rows of the brackets, each with its own."""
        of = brackets.groupBy(*g).agg(F.collect_set(F.struct("lo", "hi", "before")).alias("_b"))
        fits = F.filter("_b", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
        return base.join(broadcast_if_small(of), g).select(*g, "_v", F.explode(fits).alias("x"))

    def narrowed(cells: DataFrame, order: str) -> DataFrame:
        """Per wanted rank the cell (lo, hi, n) of its bracket that holds it."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*g, "x").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = cells.withColumn("before", F.col("x.before") + before)
        asked = broadcast_if_small(wanted.select(*[F.col(c).alias(f"_g_{c}") for c in g], "r", "total"))
        on = [F.col(c) == F.col(f"_g_{c}") for c in g]
        return placed.join(asked, [*on, F.col("r") >= F.col("before"), F.col("r") < F.col("before") + F.col("n")]).select(*g, "lo", "hi", "before", "n", "total", "r")

    found = None
    while True:
        done, rest = wanted.where("lo = hi"), wanted.where("lo < hi")
        found = done if found is None else found.unionByName(done)
        most = rest.agg(F.max("n")).collect()[0][0]  # one row
        if most is None:
            break
        wanted = rest
        if most <= QUANTILE_ROWS:
            values = inside(rest).groupBy(*g, "x", "_v").agg(F.count(F.lit(1)).alias("n"))
            found = found.unionByName(narrowed(values.withColumns({"lo": F.col("_v"), "hi": F.col("_v")}), "_v"))
            break
        cell = F.least(F.floor((F.col("_v") - F.col("x.lo")) / (F.col("x.hi") - F.col("x.lo")) * QUANTILE_CELLS), F.lit(QUANTILE_CELLS - 1))
        cells = inside(rest).groupBy(*g, "x", cell.alias("c")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
        wanted = narrowed(cells, "c").checkpoint()
    # a group's few values in one map, looked up for every probability
    known = found.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("r", "lo"))).alias("_at"), F.max("total").alias("n"))
    pos = F.col("q") * (F.col("n") - 1)
    at = known.select(*g, "_at", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")).select(
        *g, "q", F.element_at("_at", F.floor(pos)).alias("_l"), F.element_at("_at", F.ceil(pos)).alias("_h"), (pos - F.floor(pos)).alias("_f"))
    return at.select(*g, "q", (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_f")).alias("value"))
