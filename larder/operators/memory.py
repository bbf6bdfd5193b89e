"""Conversation and preference memory (P15, W5, W6, W10, W11, W13, W14,
W16, D10, D25, D26, D33, D34, E5, J20, D29).

The reference keeps this state by select-then-update per event; here each
piece is a closed-form aggregate over the event history, so the batch jobs
and their streaming twins (``larder.streaming``) compute the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Preference confidence on first mention, step, cap.
CONF_START, CONF_STEP, CONF_CAP = 0.7, 0.1, 1.0
# Expiry offsets (days) for temporal mentions.
EXPIRY_DAYS = [("next_week", 7), ("this_month", 30)]
# Per-bucket limits used when preferences are formatted
# (None = all).
BUCKET_LIMITS = [("likes", 5), ("dislikes", 5), ("cuisines", 3), ("dietary", None), ("temporal", 1)]


def preference_memory(feedback: DataFrame) -> DataFrame:
    """One preference per (user, type, key).

    frequency = mentions; confidence = min(1, 0.7 + 0.1 (n - 1)) rounded to 6
    digits (closed form of the repeated +0.1, K15); value = entity type of
    the latest mention; last_mentioned = latest time; expires_at from the
    **first** mention's timing only (K14). All aggregates are algebraic
    (count, max, min_by, max_by), so a hot key is combined map-side.
    """
    first = F.min_by(F.struct("extracted_at", "timing"), F.struct("extracted_at", "feedback_id"))
    last = F.max_by(F.col("entity_type"), F.struct("extracted_at", "feedback_id"))
    g = (feedback.groupBy("user_id", F.col("feedback_type").alias("preference_type"),
                          F.col("entity_name").alias("preference_key"))
         .agg(F.count(F.lit(1)).cast("long").alias("frequency"), last.alias("preference_value"),
              F.max("extracted_at").alias("last_mentioned"), first.alias("first")))
    expiry = None
    for timing, days in EXPIRY_DAYS:
        e = F.col("first.extracted_at") + F.make_dt_interval(F.lit(days))
        expiry = (F.when(F.col("first.timing") == timing, e) if expiry is None
                  else expiry.when(F.col("first.timing") == timing, e))
    conf = F.round(F.least(F.lit(CONF_CAP), F.lit(CONF_START) + F.lit(CONF_STEP) * (F.col("frequency") - 1)), 6)
    return g.select("user_id", "preference_type", "preference_key", "preference_value",
                    conf.alias("confidence_score"), "frequency", "last_mentioned",
                    expiry.alias("expires_at"))


def active_preferences(prefs: DataFrame, now: str) -> DataFrame:
    """Active and not expired at ``now``."""
    t = F.lit(now).cast("timestamp_ntz")
    return prefs.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > t)))


def preference_bucket(ptype: Column, value: Column) -> Column:
    """Likes, dislikes, cuisines, dietary, temporal, other (test order)."""
    return (F.when(ptype == "like", F.lit("likes")).when(ptype == "dislike", F.lit("dislikes"))
            .when((ptype == "temporal_preference") & (value == "cuisine"), F.lit("cuisines"))
            .when(F.contains(ptype, F.lit("dietary")), F.lit("dietary"))
            .when(F.contains(ptype, F.lit("temporal")), F.lit("temporal"))
            .otherwise(F.lit("other")))


def preference_topk(active: DataFrame) -> DataFrame:
    """Per user and bucket, the first n by frequency then recency
    (5 likes, 5 dislikes, 3 cuisines, all dietary, 1 temporal). Bounded
    buckets use a constant limit (planned as a WindowGroupLimit, then cut
    to each bucket's own n); the unbounded bucket is ranked on its own."""
    b = active.withColumn("bucket", preference_bucket(F.col("preference_type"), F.col("preference_value")))
    w = Window.partitionBy("user_id", "bucket").orderBy(
        F.col("frequency").desc(), F.col("last_mentioned").desc(), F.col("preference_key").asc())
    bounded = [(name, n) for name, n in BUCKET_LIMITS if n is not None]
    unbounded = [name for name, n in BUCKET_LIMITS if n is None]
    top_n = max(n for _, n in bounded)
    lim = None
    for name, n in bounded:
        lim = F.when(F.col("bucket") == name, F.lit(n)) if lim is None else lim.when(F.col("bucket") == name, F.lit(n))
    capped = (b.where(F.col("bucket").isin(*[n for n, _ in bounded]))
              .withColumn("bucket_rank", F.row_number().over(w)).where(F.col("bucket_rank") <= top_n)
              .where(F.col("bucket_rank") <= lim))
    rest = b.where(F.col("bucket").isin(*unbounded)).withColumn("bucket_rank", F.row_number().over(w))
    return capped.unionByName(rest)


def explicit_feedback(feedback: Column) -> list[Column]:
    """Like -> positive/5/thumbs_up, otherwise negative/1/thumbs_down."""
    like = feedback == "like"
    return [F.when(like, F.lit("positive")).otherwise(F.lit("negative")).alias("sentiment"),
            F.when(like, F.lit(5)).otherwise(F.lit(1)).alias("intensity"),
            F.when(like, F.lit("thumbs_up")).otherwise(F.lit("thumbs_down")).alias("source")]


def thread_counters(messages: DataFrame) -> DataFrame:
    """message_count and last_message_at per thread."""
    return messages.groupBy("thread_id").agg(F.count(F.lit(1)).cast("long").alias("message_count"),
                                             F.max("created_at").alias("last_message_at"))


def thread_title(first_message: Column) -> Column:
    """Up to the first '?' when one occurs in the first 100 characters,
    else the first 50 characters; '...' when the message is longer than 50."""
    has_q = F.contains(F.substring(first_message, 1, 100), F.lit("?"))
    base = F.when(has_q, F.concat(F.substring_index(first_message, "?", 1), F.lit("?"))) \
        .otherwise(F.substring(first_message, 1, 50))
    return F.when(F.length(first_message) > 50, F.concat(base, F.lit("..."))).otherwise(base)


def first_user_message(messages: DataFrame) -> DataFrame:
    """The first user message of each thread (min_by, no sort of the thread)."""
    u = messages.where(F.col("role") == "user")
    return u.groupBy("thread_id").agg(F.min_by("content", F.struct("created_at", "message_id")).alias("first_message"))


def recent_threads(threads: DataFrame, limit: int = 3) -> DataFrame:
    """The newest ``limit`` active threads per user by last message."""
    w = Window.partitionBy("user_id").orderBy(F.col("last_message_at").desc(), F.col("thread_id").desc())
    return (threads.where(F.col("is_active")).withColumn("thread_rank", F.row_number().over(w))
            .where(F.col("thread_rank") <= limit))


def thread_context_first_n(messages: DataFrame, n: int) -> DataFrame:
    """The **first** n messages of each thread in time order."""
    w = Window.partitionBy("thread_id").orderBy(F.col("created_at").asc(), F.col("message_id").asc())
    return messages.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def thread_context_last_n(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n messages of each thread, numbered oldest first. The
    newest n come from a WindowGroupLimit; the numbering runs over those n
    rows only, so a long thread never sits in one task."""
    w = Window.partitionBy("thread_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    last = messages.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")
    asc = Window.partitionBy("thread_id").orderBy(F.col("created_at").asc(), F.col("message_id").asc())
    return last.withColumn("pos", F.row_number().over(asc))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Newest checkpoint per thread (max_by over (created_at, id))."""
    best = F.max_by(F.struct("checkpoint_id", "created_at", "checkpoint_data"),
                    F.struct("created_at", "checkpoint_id"))
    return checkpoints.groupBy("thread_id").agg(best.alias("c")).select(
        "thread_id", "c.checkpoint_id", "c.created_at", "c.checkpoint_data")


def cumulative_conversation(messages: DataFrame, text_col: str = "content") -> DataFrame:
    """The query at turn t is the space-join of turns 1..t (user turns)."""
    w = (Window.partitionBy("thread_id").orderBy("turn")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("cumulative_query", F.array_join(F.collect_list(text_col).over(w), " "))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each assistant reply with the message just before it.

    ``turn`` is the message position in the thread, so the previous message
    is an equi-join on (thread, turn - 1): keyed by an almost unique pair, it
    spreads a very long thread over many tasks (a window would put the
    whole thread in one task).
    """
    a = messages.where(F.col("role") == "assistant").select("thread_id", "turn", F.col("content").alias("reply"))
    p = messages.select("thread_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("prev_content"),
                        F.col("role").alias("prev_role"))
    j = a.join(p, ["thread_id", "turn"], "inner")
    return j.withColumn("entity_name", F.concat(F.lit("Response about: "), F.substring("prev_content", 1, 30),
                                                F.lit("...")))


def dedupe_tool_calls(calls: DataFrame) -> DataFrame:
    """E5: keep only the first execution of each (thread, tool, query);
    later repeats are flagged ``skipped``. The first call per key is an
    aggregate (combined map-side) joined back, so a key repeated millions
    of times is not one task."""
    keys = ["thread_id", "tool", "query"]
    first = calls.groupBy(*keys).agg(F.min(F.struct("turn", "call_pos")).alias("_first"))
    return (calls.join(first, keys)
            .withColumn("skipped", F.struct("turn", "call_pos") != F.col("_first")).drop("_first"))


def user_context_join(users: DataFrame, inventory: DataFrame, prev_meals: DataFrame,
                      top_prefs: DataFrame) -> DataFrame:
    """One row per user: profile, items in stock, last meals (bounded
    top-k list), preference text per bucket (bounded by W14). Unbounded
    sides are reduced to counts before the join; only bounded lists are
    collected."""
    inv = inventory.where(F.col("quantity") > 0).groupBy("user_id").agg(F.count(F.lit(1)).cast("long").alias("inventory_items"))
    meals = prev_meals.groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("meal_rank", "meal_label"))),
                                 lambda x: x["meal_label"]), ", ").alias("previous_meals"))
    prefs = top_prefs.groupBy("user_id").agg(*[
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.struct("bucket_rank", "preference_key")))),
                                 lambda x: x["preference_key"]), ", ").alias(f"{b}_text")
        for b, _ in BUCKET_LIMITS])
    return (users.join(inv, "user_id", "left").join(meals, "user_id", "left").join(prefs, "user_id", "left")
            .withColumn("inventory_items", F.coalesce("inventory_items", F.lit(0))))
