"""Conversation and preference memory queries over events/conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import memory as mm
from larder.operators import meals as ml
from larder.plans import analogues as an
from larder.plans.q_meals import _frames
from larder.plans.registry import register

NOW = "2024-01-20 00:00:00"
FB = an.FEEDBACK_SQL
MSG = an.MESSAGES_SQL

D10_SQL = f"""SELECT user_id, feedback_type AS preference_type, entity_name AS preference_key,
  arg_max(entity_type, (extracted_at, feedback_id)) AS preference_value,
  round(least(1.0::DOUBLE, 0.7::DOUBLE + 0.1::DOUBLE * (COUNT(*) - 1)), 6) AS confidence_score,
  CAST(COUNT(*) AS BIGINT) AS frequency, max(extracted_at) AS last_mentioned,
  CASE arg_min_null(timing, (extracted_at, feedback_id)) WHEN 'next_week' THEN min(extracted_at) + INTERVAL 7 DAY
    WHEN 'this_month' THEN min(extracted_at) + INTERVAL 30 DAY END AS expires_at
FROM ({FB}) GROUP BY 1, 2, 3"""
PREFS_SQL = f"SELECT *, user_id % 10 != 0 AS is_active FROM ({D10_SQL})"
ACTIVE_SQL = f"SELECT * FROM ({PREFS_SQL}) WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"
BUCKET_SQL = """CASE WHEN preference_type = 'like' THEN 'likes' WHEN preference_type = 'dislike' THEN 'dislikes'
  WHEN preference_type = 'temporal_preference' AND preference_value = 'cuisine' THEN 'cuisines'
  WHEN contains(preference_type, 'dietary') THEN 'dietary' WHEN contains(preference_type, 'temporal') THEN 'temporal'
  ELSE 'other' END"""
TOPK_SQL = f"""SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, bucket
    ORDER BY frequency DESC, last_mentioned DESC, preference_key) AS INTEGER) AS bucket_rank
  FROM (SELECT *, {BUCKET_SQL} AS bucket FROM ({ACTIVE_SQL})))
WHERE (bucket = 'likes' AND bucket_rank <= 5) OR (bucket = 'dislikes' AND bucket_rank <= 5)
  OR (bucket = 'cuisines' AND bucket_rank <= 3) OR bucket = 'dietary' OR (bucket = 'temporal' AND bucket_rank <= 1)"""


def prefs(spark, d):
    return mm.preference_memory(an.feedback(spark, d)).withColumn("is_active", F.col("user_id") % 10 != 0)


@register("preference_memory", D10_SQL)
def q_preference_memory(spark, d):
    return mm.preference_memory(an.feedback(spark, d))


@register("active_preferences", f"SELECT user_id, preference_type, preference_key, frequency, expires_at FROM ({ACTIVE_SQL})")
def q_active_preferences(spark, d):
    return mm.active_preferences(prefs(spark, d), NOW).select(
        "user_id", "preference_type", "preference_key", "frequency", "expires_at")


@register("preference_buckets", f"SELECT user_id, preference_type, preference_key, {BUCKET_SQL} AS bucket FROM ({PREFS_SQL})")
def q_preference_buckets(spark, d):
    p = prefs(spark, d)
    return p.select("user_id", "preference_type", "preference_key",
                    mm.preference_bucket(F.col("preference_type"), F.col("preference_value")).alias("bucket"))


@register("preference_topk", f"SELECT user_id, bucket, preference_key, frequency, bucket_rank FROM ({TOPK_SQL})")
def q_preference_topk(spark, d):
    return mm.preference_topk(mm.active_preferences(prefs(spark, d), NOW)).select(
        "user_id", "bucket", "preference_key", "frequency", "bucket_rank")


@register("explicit_feedback", f"""SELECT feedback_id, CASE WHEN feedback_type = 'like' THEN 'positive' ELSE 'negative' END AS sentiment,
  CASE WHEN feedback_type = 'like' THEN 5 ELSE 1 END AS intensity,
  CASE WHEN feedback_type = 'like' THEN 'thumbs_up' ELSE 'thumbs_down' END AS source
FROM ({FB}) WHERE feedback_type IN ('like', 'dislike')""")
def q_explicit_feedback(spark, d):
    f = an.feedback(spark, d).where(F.col("feedback_type").isin("like", "dislike"))
    return f.select("feedback_id", *mm.explicit_feedback(F.col("feedback_type")))


D25_SQL = f"SELECT thread_id, CAST(COUNT(*) AS BIGINT) AS message_count, max(created_at) AS last_message_at FROM ({MSG}) GROUP BY thread_id"


@register("thread_counters", D25_SQL)
def q_thread_counters(spark, d):
    return mm.thread_counters(an.messages(spark, d))


@register("thread_title", f"""SELECT thread_id, CASE WHEN length(m) > 50 THEN t || '...' ELSE t END AS title FROM (
  SELECT thread_id, m, CASE WHEN contains(substr(m, 1, 100), '?') THEN split_part(m, '?', 1) || '?' ELSE substr(m, 1, 50) END AS t
  FROM (SELECT thread_id, arg_min(content, (created_at, message_id)) AS m FROM ({MSG}) WHERE role = 'user' GROUP BY thread_id))""")
def q_thread_title(spark, d):
    f = mm.first_user_message(an.messages(spark, d))
    return f.select("thread_id", mm.thread_title(F.col("first_message")).alias("title"))


def threads(spark, d):
    t = an.threads(spark, d).drop("updated_at")
    return t.join(mm.thread_counters(an.messages(spark, d)), "thread_id")


@register("recent_threads", f"""SELECT user_id, thread_id, CAST(rn AS INTEGER) AS thread_rank FROM (
  SELECT t.user_id, t.thread_id, ROW_NUMBER() OVER (PARTITION BY t.user_id ORDER BY c.last_message_at DESC, t.thread_id DESC) AS rn
  FROM ({an.THREADS_SQL}) t JOIN ({D25_SQL}) c USING (thread_id) WHERE t.is_active) WHERE rn <= 3""")
def q_recent_threads(spark, d):
    return mm.recent_threads(threads(spark, d)).select("user_id", "thread_id", "thread_rank")


@register("thread_context_first_n", f"""SELECT thread_id, message_id, role, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY created_at, message_id) AS pos FROM ({MSG})) WHERE pos <= 4""")
def q_thread_context_first_n(spark, d):
    return mm.thread_context_first_n(an.messages(spark, d), 4).select("thread_id", "message_id", "role", "pos")


@register("thread_context_last_n", f"""SELECT thread_id, message_id, role, CAST(least(cnt, 5) - back + 1 AS INTEGER) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY created_at DESC, message_id DESC) AS back,
    COUNT(*) OVER (PARTITION BY thread_id) AS cnt FROM ({MSG})) WHERE back <= 5""")
def q_thread_context_last_n(spark, d):
    return mm.thread_context_last_n(an.messages(spark, d), 5).select("thread_id", "message_id", "role", "pos")


@register("latest_checkpoint", f"""SELECT thread_id, arg_max(message_id, (created_at, message_id)) AS checkpoint_id,
  max(created_at) AS created_at, arg_max(role, (created_at, message_id)) AS checkpoint_data FROM ({MSG}) GROUP BY thread_id""")
def q_latest_checkpoint(spark, d):
    cp = an.messages(spark, d).select("thread_id", F.col("message_id").alias("checkpoint_id"), "created_at",
                                      F.col("role").alias("checkpoint_data"))
    return mm.latest_checkpoint(cp)


@register("cumulative_conversation", f"""SELECT thread_id, turn, string_agg(content, ' ') OVER (PARTITION BY thread_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_query FROM ({MSG}) WHERE role = 'user'""")
def q_cumulative_conversation(spark, d):
    u = an.messages(spark, d).where(F.col("role") == "user")
    return mm.cumulative_conversation(u).select("thread_id", "turn", "cumulative_query")


@register("turn_pairs", f"""SELECT a.thread_id, a.turn, p.role AS prev_role, 'Response about: ' || substr(p.content, 1, 30) || '...' AS entity_name
FROM ({MSG}) a JOIN ({MSG}) p ON a.thread_id = p.thread_id AND a.turn = p.turn + 1 WHERE a.role = 'assistant'""")
def q_turn_pairs(spark, d):
    return mm.turn_pairs(an.messages(spark, d)).select("thread_id", "turn", "prev_role", "entity_name")


def _calls(spark, d):
    m = an.messages(spark, d).where(F.col("role") == "assistant")
    return m.select("thread_id", "turn", F.lit(0).alias("call_pos"), F.lit("search_foods").alias("tool"),
                    F.concat(F.lit("q"), (F.length("content") % 4).cast("string")).alias("query"))


@register("dedupe_tool_calls", f"""SELECT thread_id, turn, query, ROW_NUMBER() OVER (PARTITION BY thread_id, tool, query ORDER BY turn) > 1 AS skipped
FROM (SELECT thread_id, turn, 'search_foods' AS tool, 'q' || CAST(length(content) % 4 AS VARCHAR) AS query FROM ({MSG}) WHERE role = 'assistant')""")
def q_dedupe_tool_calls(spark, d):
    return mm.dedupe_tool_calls(_calls(spark, d)).select("thread_id", "turn", "query", "skipped")


PREV_MEALS_SQL = f"""SELECT user_id, upper(left(meal_type, 1)) || lower(substr(meal_type, 2)) || ': ' || meal_name AS meal_label, rn AS meal_rank FROM (
  SELECT dm.user_id, md.meal_type, md.meal_name, ROW_NUMBER() OVER (PARTITION BY dm.user_id ORDER BY mp.created_at DESC, dm.plan_id DESC,
    dm.day_number, md.meal_type, md.detail_id) AS rn
  FROM ({an.DAILY_MEALS_SQL}) dm JOIN ({an.MEAL_DETAILS_SQL}) md ON dm.meal_id = md.meal_id JOIN ({an.MEAL_PLANS_SQL}) mp ON dm.plan_id = mp.plan_id
  WHERE mp.status = 'ACTIVE')
WHERE rn <= 28"""


def _btxt(b):
    return f"COALESCE(string_agg(CASE WHEN bucket = '{b}' THEN preference_key END, ', ' ORDER BY bucket_rank), '') AS {b}_text"


@register("user_context_join", f"""SELECT u.user_id, u.username, COALESCE(i.n, 0) AS inventory_items, m.previous_meals,
  p.likes_text, p.dislikes_text, p.cuisines_text, p.dietary_text, p.temporal_text
FROM ({an.USERS_SQL}) u
LEFT JOIN (SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n FROM ({an.INVENTORY_SQL}) WHERE quantity > 0 GROUP BY user_id) i ON u.user_id = i.user_id
LEFT JOIN (SELECT user_id, string_agg(meal_label, ', ' ORDER BY meal_rank) AS previous_meals FROM ({PREV_MEALS_SQL}) GROUP BY user_id) m ON u.user_id = m.user_id
LEFT JOIN (SELECT user_id, {', '.join(_btxt(b) for b, _ in mm.BUCKET_LIMITS)} FROM ({TOPK_SQL}) GROUP BY user_id) p ON u.user_id = p.user_id""")
def q_user_context_join(spark, d):
    top = mm.preference_topk(mm.active_preferences(prefs(spark, d), NOW))
    prev = ml.previous_meals(*_frames(spark, d))
    out = mm.user_context_join(an.users(spark, d), an.inventory(spark, d), prev, top)
    return out.select("user_id", "username", "inventory_items", "previous_meals",
                      *[f"{b}_text" for b, _ in mm.BUCKET_LIMITS])


INV_CATS_SQL = f"""SELECT user_id, string_agg(category || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY category) AS inventory FROM (
  SELECT user_id, CASE WHEN category IS NULL OR category = '' THEN 'Other' ELSE category END AS category, COUNT(*) AS n
  FROM ({an.INVENTORY_SQL}) WHERE quantity > 0 GROUP BY 1, 2) GROUP BY user_id"""


@register("user_prompt_rows", f"""WITH t AS ({__import__('larder.plans.q_nutrition', fromlist=['x']).targets_sql()}),
m AS (SELECT user_id, string_agg(meal_label, ', ' ORDER BY meal_rank) AS prev FROM ({PREV_MEALS_SQL}) GROUP BY user_id)
SELECT t.user_id, printf('User %s, age %d, %s, %.1f kg, %.1f cm. Goal: %s. Targets: %d kcal, %.1f g protein. Inventory: %s. Plan dates: %s to %s. Previous meals: %s',
  t.username, t.age, t.gender, t.weight_kg, t.height_cm, t.health_goal, t.daily_calories, t.daily_protein,
  COALESCE(i.inventory, 'none'), strftime(DATE '{an.AS_OF}' + 1, '%B %d, %Y'), strftime(DATE '{an.AS_OF}' + 7, '%B %d, %Y'),
  COALESCE(m.prev, 'none')) AS prompt
FROM t LEFT JOIN ({INV_CATS_SQL}) i ON t.user_id = i.user_id LEFT JOIN m ON t.user_id = m.user_id""")
def q_user_prompt_rows(spark, d):
    """One prompt text per user (text assembly only; the inventory is
    summarized per category and the meal list is the bounded top 28)."""
    from larder.operators import nutrition as nu
    from larder.operators import pantry as pt
    t = nu.nutrition_targets(an.users(spark, d), spark)
    inv = an.inventory(spark, d).where(F.col("quantity") > 0).withColumn("category", pt.inventory_category(F.col("category")))
    cats = inv.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    inv_txt = cats.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category", "n"))),
                                                                   lambda x: F.concat(x["category"], F.lit(": "), x["n"].cast("string"))), ", ").alias("inventory"))
    prev = ml.previous_meals(*_frames(spark, d))
    m = prev.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("meal_rank", "meal_label"))),
                                                             lambda x: x["meal_label"]), ", ").alias("prev"))
    as_of = F.lit(an.AS_OF).cast("date")
    j = t.join(inv_txt, "user_id", "left").join(m, "user_id", "left")
    prompt = F.format_string(
        "User %s, age %d, %s, %.1f kg, %.1f cm. Goal: %s. Targets: %d kcal, %.1f g protein. Inventory: %s. Plan dates: %s to %s. Previous meals: %s",
        "username", "age", "gender", "weight_kg", "height_cm", "health_goal", "daily_calories", "daily_protein",
        F.coalesce("inventory", F.lit("none")), F.date_format(F.date_add(as_of, 1), "MMMM dd, yyyy"),
        F.date_format(F.date_add(as_of, 7), "MMMM dd, yyyy"), F.coalesce("prev", F.lit("none")))
    return j.select("user_id", prompt.alias("prompt"))
