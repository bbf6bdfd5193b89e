"""Scheduling queries over the order-based schedule analogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import scheduling as sc
from larder.plans import analogues as an
from larder.plans.registry import register
from larder.sources.tables import table

AS_OF = an.AS_OF
SCHED = an.SCHEDULES_SQL


@register("due_users", f"""SELECT schedule_id, user_id, next_plan_date FROM ({SCHED})
  WHERE next_plan_date <= DATE '{AS_OF}' AND status = 'ACTIVE'""")
def q_due_users(spark, d):
    return sc.due_users(an.schedules(spark, d), AS_OF).select("schedule_id", "user_id", "next_plan_date")


W8_SQL = f"""SELECT user_id, min(next_plan_date) AS next_plan_date, arg_min(schedule_id, (next_plan_date, schedule_id)) AS schedule_id
FROM (SELECT DISTINCT user_id, next_plan_date, schedule_id FROM ({SCHED}) WHERE next_plan_date <= DATE '{AS_OF}' AND status = 'ACTIVE')
GROUP BY user_id"""


@register("first_schedule_per_user", W8_SQL)
def q_first_schedule_per_user(spark, d):
    return sc.first_schedule_per_user(an.schedules(spark, d), AS_OF)


J6_SQL = f"""SELECT DISTINCT u.username, s.next_plan_date, s.status, s.user_id FROM ({SCHED}) s
  JOIN ({an.USERS_SQL}) u ON s.user_id = u.user_id WHERE s.status = 'ACTIVE'"""


@register("generation_queue_join", J6_SQL)
def q_generation_queue_join(spark, d):
    return sc.generation_queue_join(an.schedules(spark, d), an.users(spark, d))


D11_SQL = f"""SELECT *, CASE WHEN next_plan_date < DATE '{AS_OF}' THEN 'Overdue (Issue)'
  WHEN next_plan_date = DATE '{AS_OF}' THEN 'Generating Today' WHEN next_plan_date = DATE '{AS_OF}' + 1 THEN 'Generating Tomorrow'
  ELSE 'Upcoming' END AS queue_status, next_plan_date <= DATE '{AS_OF}' + 1 AS in_details FROM ({J6_SQL})"""


@register("generation_queue", D11_SQL)
def q_generation_queue(spark, d):
    return sc.generation_queue(sc.generation_queue_join(an.schedules(spark, d), an.users(spark, d)), AS_OF)


@register("queue_status_counts", f"""SELECT CAST(COUNT(CASE WHEN queue_status = 'Overdue (Issue)' THEN 1 END) AS BIGINT) AS overdue_count,
  CAST(COUNT(CASE WHEN queue_status = 'Generating Today' THEN 1 END) AS BIGINT) AS today_count,
  CAST(COUNT(CASE WHEN queue_status = 'Generating Tomorrow' THEN 1 END) AS BIGINT) AS tomorrow_count,
  CAST(COUNT(CASE WHEN in_details THEN 1 END) AS BIGINT) AS detail_rows FROM ({D11_SQL})""")
def q_queue_status_counts(spark, d):
    q = sc.generation_queue(sc.generation_queue_join(an.schedules(spark, d), an.users(spark, d)), AS_OF)
    return sc.queue_status_counts(q)


@register("schedule_rollforward", f"""SELECT s.schedule_id, s.user_id,
  CASE WHEN p.schedule_id IS NOT NULL AND s.schedule_id != p.schedule_id THEN 'INACTIVE' ELSE s.status END AS status,
  CASE WHEN p.schedule_id IS NOT NULL AND s.schedule_id = p.schedule_id THEN DATE '{AS_OF}' + 7 ELSE s.next_plan_date END AS next_plan_date
FROM ({SCHED}) s LEFT JOIN ({W8_SQL}) p ON s.user_id = p.user_id""")
def q_schedule_rollforward(spark, d):
    s = an.schedules(spark, d)
    done = sc.first_schedule_per_user(s, AS_OF)
    return sc.schedule_rollforward(s, done, AS_OF).select("schedule_id", "user_id", "status", "next_plan_date")


_NEW_PLANS = f"SELECT user_id FROM ({W8_SQL})"


@register("new_plan_schedules", f"""SELECT CAST(schedule_id AS VARCHAR) AS schedule_id, user_id, plan_start_date, plan_end_date, next_plan_date,
  CASE WHEN user_id IN ({_NEW_PLANS}) THEN 'INACTIVE' ELSE status END AS status FROM ({SCHED})
UNION ALL SELECT sha256(concat_ws('|', user_id, strftime(DATE '{AS_OF}' + 1, '%Y-%m-%d'))), user_id, DATE '{AS_OF}' + 1, DATE '{AS_OF}' + 8, DATE '{AS_OF}' + 6, 'ACTIVE'
FROM ({_NEW_PLANS})""")
def q_new_plan_schedules(spark, d):
    """The schedule table after a run: due users have a new schedule, their
    earlier ones are closed. Two merges by id."""
    from larder.session import run_dir
    from larder.sources.merge import MergeTable
    s = an.schedules(spark, d).select(F.col("schedule_id").cast("string").alias("schedule_id"), "user_id", "plan_start_date", "plan_end_date", "next_plan_date", "status")
    due = sc.first_schedule_per_user(an.schedules(spark, d), AS_OF)
    t = MergeTable(spark, run_dir(spark, "larder/new_plan_schedules"), "schedule_id", 8)
    t.create(s)
    t.update(sc.closed_schedules(s, due), ["status"])
    t.update(sc.schedules_of_new_plans(due, AS_OF), ["user_id", "plan_start_date", "next_plan_date", "plan_end_date", "status"], insert=True)
    return t.read()


@register("workflow_outcome_counts", f"""SELECT outcome, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'error' WHEN o.o_orderstatus = 'P' THEN 'failure' ELSE 'success' END AS outcome
  FROM ({W8_SQL}) w JOIN orders o ON w.schedule_id = o.o_orderkey) GROUP BY outcome""")
def q_workflow_outcome_counts(spark, d):
    w = sc.first_schedule_per_user(an.schedules(spark, d), AS_OF)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    j = w.join(o, w.schedule_id == o.o_orderkey)
    outcome = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("error"))
               .when(F.col("o_orderstatus") == "P", F.lit("failure")).otherwise(F.lit("success")))
    return sc.workflow_outcome_counts(j.select(outcome.alias("outcome")))
