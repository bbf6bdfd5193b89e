"""The stateful jobs R1-R8 as functions of a streaming source.

Each takes a streaming DataFrame of the source table, runs what is new in it
(``availableNow``) and returns the result over all batches so far. Given a
``location``, a later call with it goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import memory as mm
from larder.plans import analogues as an
from larder.streaming import jobs as sj

DAY = 24 * 3600


def _place(stream: DataFrame, location: str | None, name: str) -> str:
    return location or sj._own_location(stream.sparkSession, name)


def preference_memory(events: DataFrame, location: str | None = None) -> DataFrame:
    """D10 as a native streaming aggregation: the state of a key is its
    number of mentions, the first one with its expiry and the last one. Events
    are combined in each task before they are dealt out by key."""
    keys = ["user_id", "preference_type", "preference_key"]
    fb = an.feedback_from(events)
    days = F.coalesce(*[F.when(F.col("timing") == timing, n) for timing, n in mm.EXPIRY_DAYS])
    expiry = F.col("extracted_at") + F.make_dt_interval(days)
    known = (fb.groupBy("user_id", F.col("feedback_type").alias("preference_type"), F.col("entity_name").alias("preference_key"))
             .agg(F.count(F.lit(1)).alias("frequency"), F.max(F.struct("extracted_at", "feedback_id", "entity_type")).alias("last"),
                  F.min(F.struct("extracted_at", "feedback_id", expiry.alias("expires_at"))).alias("first")))
    g = sj.run_state(known, keys, _place(events, location, "preference_memory"))
    conf = F.round(F.least(F.lit(mm.CONF_CAP), F.lit(mm.CONF_START) + F.lit(mm.CONF_STEP) * (F.col("frequency") - 1)), 6)
    return g.select(*keys, F.col("last.entity_type").alias("preference_value"), conf.alias("confidence_score"),
                    F.col("frequency").cast("long").alias("frequency"), F.col("last.extracted_at").alias("last_mentioned"), F.col("first.expires_at").alias("expires_at"))


def thread_counters(conversations: DataFrame, location: str | None = None) -> DataFrame:
    """R2: D25 as a native streaming aggregation."""
    return sj.run_state(mm.thread_counters(an.messages_from(conversations)), ["thread_id"], _place(conversations, location, "thread_counters"))


def latest_checkpoint(conversations: DataFrame, location: str | None = None) -> DataFrame:
    """The newest checkpoint per thread, as a native streaming aggregation."""
    m = an.messages_from(conversations)
    best = m.groupBy("thread_id").agg(F.max(F.struct("created_at", F.col("message_id").alias("checkpoint_id"), F.col("role").alias("checkpoint_data"))).alias("c"))
    last = best.select("thread_id", "c.checkpoint_id", "c.created_at", "c.checkpoint_data")
    return sj.run_state(last, ["thread_id"], _place(conversations, location, "latest_checkpoint"))


def _means(events: DataFrame, key: str, window: tuple[str, ...], out: str, delay: int, location: str | None, name: str) -> DataFrame:
    sums = [F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n")]
    g = sj.run_windows(events, "ts", delay, [F.col(key)], window, sums, _place(events, location, name))
    return g.select(key, sj.day_of(F.col("start")).alias(out), F.round(F.try_divide("total", "n_values"), 6).alias("avg_value"), F.col("n").cast("long").alias("n"))


def weekly_nutrition(events: DataFrame, location: str | None = None, delay: int = 14 * DAY) -> DataFrame:
    """Means per user and week (Monday first: 1970 began on a Thursday)."""
    return _means(events, "user_id", ("7 days", "7 days", "4 days"), "week_start", delay, location, "weekly_nutrition")


def daily_trend(events: DataFrame, location: str | None = None, delay: int = 2 * DAY) -> DataFrame:
    """Means per event type and day."""
    return _means(events, "event_type", ("1 day",), "day", delay, location, "eval_trend")


def feedback_sliding(events: DataFrame, location: str | None = None, delay: int = 2 * DAY) -> DataFrame:
    """Likes and dislikes over 7-day windows that slide by a day."""
    fb = an.feedback_from(events).where(F.col("feedback_type").isin("like", "dislike"))
    g = sj.run_windows(fb, "extracted_at", delay, [F.col("feedback_type")], ("7 days", "1 day"), [F.count(F.lit(1)).alias("n")],
                       _place(events, location, "feedback_sliding"))
    return g.select(sj.day_of(F.col("start")).alias("window_start"), "feedback_type", F.col("n").cast("long").alias("n"))


def dedupe_calls(conversations: DataFrame, location: str | None = None, delay: int = DAY) -> DataFrame:
    """Each (thread, tool, query) once, however far apart its calls are:
    state drops the repeats within the watermark; late calls, and repeats that
    came after the state had gone, meet it when the result is read."""
    keys = ["thread_id", "tool", "query"]
    place = _place(conversations, location, "dedupe_calls")
    m = an.messages_from(conversations).where(F.col("role") == "assistant")
    calls = m.select("thread_id", F.lit("search_foods").alias("tool"), F.concat(F.lit("q"), (F.length("content") % 4).cast("string")).alias("query"), "created_at")

    def once(rows: DataFrame) -> DataFrame:
        return rows.select(*keys).distinct()
    routed = sj.Routed(calls, "created_at", delay, once, once, place)
    timed = routed.on_time.withColumn("_time", sj.instant(F.col("created_at"))).withWatermark("_time", f"{delay} seconds")
    found = sj.run_partials(timed.dropDuplicatesWithinWatermark(keys), once, once, f"{place}/dedupe", "dedupe_calls")
    return once(found.unionByName(routed.late.read()))


def chat_sessions(events: DataFrame, gap_seconds: int = 30 * 60, location: str | None = None) -> DataFrame:
    """Sessions per user that end with a gap. A batch leaves intervals;
    intervals of all batches that come within the gap are one session."""
    log = sj.run_partials(events.select("user_id", "ts"), lambda b: sj.event_intervals(b, "user_id", "ts", gap_seconds),
                          lambda rows: sj.combined_intervals(rows, "user_id", gap_seconds), location, "chat_sessions")
    merged = sj.merge_intervals(log, "user_id", gap_seconds)
    return merged.select("user_id", F.col("s").alias("session_start"), (F.col("l") + sj.gap_of(gap_seconds)).alias("session_end"),
                         F.col("n").cast("long").alias("n_events"))
