"""Streaming jobs R1-R8; each batch twin's SQL is the oracle."""

from __future__ import annotations

from larder.plans import analogues as an
from larder.plans.q_memory import D10_SQL, D25_SQL, MSG
from larder.plans.registry import register
from larder.streaming import jobs as sj
from larder.streaming import pipelines as sp


def _run(job, spark, d, name):
    """A job over a table's files, at the place that it has for this table."""
    return job(sj.stream_table(spark, d, name), location=sj.job_location(spark, job.__name__, f"{d}/{name}"))


@register("stream_preference_memory", D10_SQL)
def q_stream_preference_memory(spark, d):
    return _run(sp.preference_memory, spark, d, "events")


@register("stream_thread_counters", D25_SQL)
def q_stream_thread_counters(spark, d):
    return _run(sp.thread_counters, spark, d, "conversations")


@register("stream_latest_checkpoint", f"""SELECT thread_id, arg_max(message_id, (created_at, message_id)) AS checkpoint_id,
  max(created_at) AS created_at, arg_max(role, (created_at, message_id)) AS checkpoint_data FROM ({MSG}) GROUP BY thread_id""")
def q_stream_latest_checkpoint(spark, d):
    return _run(sp.latest_checkpoint, spark, d, "conversations")


@register("stream_weekly_nutrition", """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, round(avg(value), 6) AS avg_value,
  CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def q_stream_weekly_nutrition(spark, d):
    return _run(sp.weekly_nutrition, spark, d, "events")


@register("stream_eval_trend", """SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 6) AS avg_value,
  CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def q_stream_eval_trend(spark, d):
    return _run(sp.daily_trend, spark, d, "events")


@register("stream_dedupe_calls", f"""SELECT DISTINCT thread_id, 'search_foods' AS tool, 'q' || CAST(length(content) % 4 AS VARCHAR) AS query
  FROM ({MSG}) WHERE role = 'assistant'""")
def q_stream_dedupe_calls(spark, d):
    return _run(sp.dedupe_calls, spark, d, "conversations")


SESSIONS_SQL = """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
    OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM events),
s AS (SELECT user_id, ts, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(COUNT(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, sid"""


@register("stream_chat_sessions", SESSIONS_SQL)
def q_stream_chat_sessions(spark, d):
    return _run(sp.chat_sessions, spark, d, "events")


@register("stream_feedback_sliding", f"""SELECT CAST(date_trunc('day', extracted_at) AS DATE) - CAST(k AS INTEGER) AS window_start, feedback_type, CAST(COUNT(*) AS BIGINT) AS n
FROM ({an.FEEDBACK_SQL}), range(0, 7) r(k) WHERE feedback_type IN ('like', 'dislike') GROUP BY 1, 2""")
def q_stream_feedback_sliding(spark, d):
    return _run(sp.feedback_sliding, spark, d, "events")
