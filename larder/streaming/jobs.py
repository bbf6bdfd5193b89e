"""Structured Streaming machinery of the stateful jobs.

A job reads the files of a table's folder as a stream and keeps what it has
found in a ``BatchLog`` beside the stream's checkpoint. Both live at one
location below the shared checkpoint folder, named by the job and its source
alone: a later run there, also by another application, takes only what is new.

Three kinds of jobs share it:

* ``run_partials``: a batch is reduced to partials that combine in any order;
* ``run_state``: the stream's own state (native aggregation) emits the new
  rows of the keys that a batch has changed, and the last row of each key is
  the result;
* ``run_windows``: watermarked state, which Spark drops as time goes on and
  which ignores late rows. A first query routes late rows to a log of their
  own, so state and late rows together lose nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.common import laid_out, scanned
from larder.session import scratch_dir
from larder.streaming.log import BatchLog

#: Files of a micro-batch.
MAX_FILES = 64


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = MAX_FILES) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files."""
    base = f"{sf_dir.rstrip('/')}/{name}"
    schema = spark.read.parquet(f"{base}.parquet").schema
    # as a pattern the path may name a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{base}[.]parquet")


def job_location(spark: SparkSession, name: str, source: str) -> str:
    """Where a job over ``source`` keeps its output and checkpoint: the same
    place for every run of every application with this checkpoint folder."""
    key = hashlib.sha256(source.rstrip("/").encode()).hexdigest()[:16]
    return scratch_dir(spark, f"larder/stream-jobs/v2/{key}/{name}")


def _own_location(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, f"larder/stream-runs/{name}/{uuid.uuid4().hex}")


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame],
                 location: str | None, name: str) -> DataFrame:
    """Run what is new in ``stream`` and return all partials, combined.

    ``partial`` reduces one micro-batch, ``combine`` the partials of several
    to ones of the same columns. Without ``location`` the run stands alone.
    """
    spark = stream.sparkSession
    base = location or _own_location(spark, name)
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    log = BatchLog(spark, f"{base}/log", schema, combine)
    _run(stream, lambda batch, n: log.append(n, partial(batch)), f"{base}/checkpoint")
    return combine(log.read())


def last_of(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The row of the latest batch for each key."""
    def combine(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*values), "batch").alias("_v")
        return rows.groupBy(*keys).agg(best, F.max("batch").alias("batch")).select(*keys, "_v.*", "batch")
    return combine


def run_state(changed: DataFrame, keys: list[str], location: str, part: str = "state") -> DataFrame:
    """Run ``changed``, a streaming frame of the keys that a batch has changed
    with their state, and return the last row of each key."""
    spark = changed.sparkSession
    values = [c for c in changed.columns if c not in keys]
    combine = last_of(keys, values)
    log = BatchLog(spark, f"{location}/{part}-log", StructType(changed.schema.fields).add("batch", "long"), combine)

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("batch", F.lit(n).cast("long"))
        log.append(n, rows)
    _run(changed, write, f"{location}/{part}-checkpoint", "update")
    return combine(log.read()).drop("batch")


class Routed:
    """The rows of ``stream`` on time, as a stream, and the late ones.

    A row is late if its ``ts`` is more than ``delay`` seconds before the
    latest of the batches before its own. Rows on time are written as files,
    of which the second query takes all that are there as one batch: its
    watermark with the same delay never passes a row of theirs. Late rows are
    reduced by ``partial`` and kept in a log.
    """

    def __init__(self, stream: DataFrame, ts: str, delay: int, partial: Callable[[DataFrame], DataFrame],
                 combine: Callable[[DataFrame], DataFrame], location: str):
        spark = stream.sparkSession
        schema = partial(spark.createDataFrame([], stream.schema)).schema
        self.late = BatchLog(spark, f"{location}/late-log", schema, combine)
        on_time = f"{location}/on-time"
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{on_time}/none")

        def route(batch: DataFrame, n: int) -> None:
            state = self.late.state()
            if n <= state["batch"]:
                return
            before = state["note"]
            latest = batch.agg(F.max(micros(F.col(ts)))).collect()[0][0]  # one row
            at = micros(F.col(ts))
            floor = None if before is None else before - delay * 1_000_000
            in_time = F.lit(True) if floor is None else F.coalesce(at >= floor, F.lit(False))
            batch.where(in_time).write.mode("overwrite").parquet(f"{on_time}/batch-{n}")
            self.late.append(n, partial(batch.where(~in_time)), max((x for x in (before, latest) if x is not None), default=None))
        _run(stream, route, f"{location}/route-checkpoint")
        self.on_time = spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true").parquet(on_time)


def run_windows(stream: DataFrame, ts: str, delay: int, keys: list[Column], window: tuple[str, ...], sums: list[Column], location: str) -> DataFrame:
    """Sums per key and window over all rows, late ones included.

    The windows are native and watermarked: state holds those that can still
    change. A late row may belong to a window that is gone from the state; its
    sums are added when the result is read. ``window``: duration, slide and
    start as ``functions.window`` takes them.
    """
    of = F.window(instant(F.col("_at")), *window).alias("window")
    names = [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in keys]
    values = [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in sums]
    stream = stream.withColumn("_at", F.col(ts))

    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys, of).agg(*sums).select(*names, F.col("window.start").alias("start"), *values)

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*names, "start").agg(*[F.sum(v).alias(v) for v in values])

    routed = Routed(stream, ts, delay, partial, combine, location)
    timed = routed.on_time.withColumn("_time", instant(F.col("_at"))).withWatermark("_time", f"{delay} seconds")
    open_windows = timed.groupBy(*keys, F.window("_time", *window).alias("window")).agg(*sums)
    state = run_state(open_windows.select(*names, F.col("window.start").alias("start"), *values), [*names, "start"], location, "windows")
    return combine(state.select(*names, "start", *values).unionByName(routed.late.read()))



def micros(ts: Column) -> Column:
    """Microseconds from 1970 to a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def instant(ts: Column) -> Column:
    """The timestamp without time zone as one with, as if it were UTC."""
    return F.timestamp_micros(micros(ts))


def day_of(start: Column) -> Column:
    """The date of an instant in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_micros(start) / 86_400_000_000).cast("int"))


def moment(micros_: Column) -> Column:
    """The timestamp without time zone so many microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", micros_, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def gap_of(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def merge_intervals(intervals: DataFrame, key: str, gap_seconds: int, n_parts: int | None = None) -> DataFrame:
    """Intervals (key, s, l, n) whose distance is under the gap become one.

    Islands over the intervals of a key in order of their starts, stitched
    over ranges: rows are range-partitioned by key and start, so a key with a
    third of all intervals is many ranges. A range learns from those before
    it how far the key's intervals reach, and where its last session began;
    both are one value a range. Sessions are then aggregates that combine in
    each task.
    """
    laid = laid_out(intervals.select(key, "s", "l", "n"), [key], ["s", "l"], n_parts)
    reached = scanned(laid, [key], {"_until": F.col("l")}, "max", before=True)
    begins = F.col("_until").isNull() | (F.col("s") >= F.col("_until") + gap_of(gap_seconds))
    marked = reached.withColumn("_begin", F.when(begins, F.col("s")))
    session = scanned(marked, [key], {"_session": F.col("_begin")}, "max")
    return session.groupBy(key, "_session").agg(F.min("s").alias("s"), F.max("l").alias("l"), F.sum("n").alias("n")).drop("_session")


def event_intervals(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of one batch, nearly: intervals (key, s, l, n).

    Events of a key within one gap-long slot are less than a gap apart, so
    they are one interval (partial aggregates in every task); intervals are
    stitched when they are read.
    """
    slot = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)) / gap_seconds)
    slots = events.groupBy(key, slot.alias("_slot")).agg(F.min(ts).alias("s"), F.max(ts).alias("l"), F.count(F.lit(1)).alias("n"))
    return slots.drop("_slot")


def combined_intervals(rows: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """The intervals of several batches, one per key and slot of their start."""
    slot = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("s")) / gap_seconds)
    return rows.groupBy(key, slot.alias("_slot")).agg(F.min("s").alias("s"), F.max("l").alias("l"), F.sum("n").alias("n")).drop("_slot")
