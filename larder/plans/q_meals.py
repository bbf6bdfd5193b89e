"""Meal-plan queries over the plan/day/meal analogues."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larder.functions import jsonfn
from larder.operators import meals as ml
from larder.plans import analogues as an
from larder.plans.registry import register
from larder.sources.tables import table

AS_OF = an.AS_OF
DAILY, DETAILS, PLANS = an.DAILY_MEALS_SQL, an.MEAL_DETAILS_SQL, an.MEAL_PLANS_SQL


def _frames(spark, d):
    return an.daily_meals(spark, d), an.meal_details(spark, d), an.meal_plans(spark, d)


THREE_WAY_SQL = f"""SELECT dm.meal_id, dm.plan_id, dm.user_id, dm.day_number, dm.day_name, dm.meal_date,
  mp.status AS plan_status, md.detail_id, md.meal_type, md.meal_name, md.preparation_time, md.servings
FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id"""
_TW_COLS = ["meal_id", "plan_id", "user_id", "day_number", "day_name", "meal_date", "plan_status",
            "detail_id", "meal_type", "meal_name", "preparation_time", "servings"]


@register("meals_three_way", THREE_WAY_SQL)
def q_meals_three_way(spark, d):
    return ml.meals_three_way(*_frames(spark, d)).select(*_TW_COLS)


@register("meals_by_criteria", f"""SELECT * FROM ({THREE_WAY_SQL}) WHERE plan_status = 'ACTIVE'
  AND day_number = 3 AND meal_type = 'dinner'""")
def q_meals_by_criteria(spark, d):
    return ml.meals_by_criteria(*_frames(spark, d), day_number=3, meal_type="dinner").select(*_TW_COLS)


@register("meals_by_date", f"""SELECT dm.meal_date, dm.day_name, mp.user_id, md.detail_id, md.meal_type,
  md.meal_name, md.servings FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id
  JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id WHERE dm.meal_date = DATE '{AS_OF}' AND md.meal_type = 'lunch'""")
def q_meals_by_date(spark, d):
    return ml.meals_by_date(*_frames(spark, d), meal_date=AS_OF, meal_type="LUNCH").select(
        "meal_date", "day_name", "user_id", "detail_id", "meal_type", "meal_name", "servings")


@register("meals_by_type", f"SELECT * FROM ({THREE_WAY_SQL}) WHERE plan_status = 'ACTIVE' AND meal_type = 'breakfast'")
def q_meals_by_type(spark, d):
    return ml.meals_by_type(*_frames(spark, d), "breakfast").select(*_TW_COLS)


@register("meals_with_ingredient", f"""WITH j AS (
  SELECT dm.user_id, dm.day_name, md.detail_id, md.meal_type, md.meal_name,
    CAST(md.ingredients AS JSON) AS ings
  FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id
  WHERE mp.status = 'ACTIVE'),
hits AS (SELECT user_id, day_name, detail_id, meal_type, meal_name,
  list_filter(CAST(json_extract_string(ings, '$[*].ingredient') AS VARCHAR[]),
              lambda x: contains(lower(coalesce(x, '')), 'sauce')) AS h FROM j)
SELECT user_id, day_name, detail_id, meal_type, meal_name, h[1] AS matching_ingredient FROM hits WHERE len(h) > 0""")
def q_meals_with_ingredient(spark, d):
    return ml.meals_with_ingredient(*_frames(spark, d), "SAUCE").select(
        "user_id", "day_name", "detail_id", "meal_type", "meal_name", "matching_ingredient")


@register("trailing_weeks", f"SELECT meal_id, user_id, meal_date FROM ({DAILY}) WHERE meal_date >= DATE '{AS_OF}' - 28")
def q_trailing_weeks(spark, d):
    return an.daily_meals(spark, d).where(ml.trailing_weeks(F.col("meal_date"), AS_OF, 4)).select(
        "meal_id", "user_id", "meal_date")


@register("plan_week_details", f"""SELECT dm.plan_id, dm.day_number, dm.meal_date, md.detail_id, md.meal_type, md.meal_name,
  CASE md.meal_type WHEN 'breakfast' THEN 1 WHEN 'lunch' THEN 2 WHEN 'snacks' THEN 3 WHEN 'dinner' THEN 4 END AS meal_type_rank
FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id""")
def q_plan_week_details(spark, d):
    daily, det, _ = _frames(spark, d)
    return ml.plan_week_details(daily, det).select("plan_id", "day_number", "meal_date", "detail_id",
                                                   "meal_type", "meal_name", "meal_type_rank")


def _nut_sql(col, field, default0=True):
    e = f"CASE WHEN json_valid({col}) THEN CAST(json_extract({col}, '$.{field}') AS DOUBLE) END"
    return f"COALESCE({e}, 0.0)" if default0 else e


@register("nutrition_history", f"""SELECT dm.user_id, dm.plan_id, mp.start_date, mp.end_date, dm.meal_date,
  {', '.join('round(' + _nut_sql('dm.total_nutrition', f) + ', 6) AS ' + f for f in jsonfn.NUTRITION_FIELDS)}
FROM ({DAILY}) dm JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id WHERE dm.meal_date >= DATE '{AS_OF}' - 28""")
def q_nutrition_history(spark, d):
    daily, _, plans = _frames(spark, d)
    return _r(ml.nutrition_history(daily, plans, AS_OF), 6)


WEEKLY_SQL = f"""SELECT user_id, week_start, avg_calories, avg_protein, avg_carbs, avg_fat, avg_fiber FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY week_start DESC) AS rn FROM (
    SELECT dm.user_id, CAST(date_trunc('week', dm.meal_date) AS DATE) AS week_start,
      AVG({_nut_sql('dm.total_nutrition', 'calories', False)}) AS avg_calories,
      AVG({_nut_sql('dm.total_nutrition', 'protein_g', False)}) AS avg_protein,
      AVG({_nut_sql('dm.total_nutrition', 'carbohydrates_g', False)}) AS avg_carbs,
      AVG({_nut_sql('dm.total_nutrition', 'fat_g', False)}) AS avg_fat,
      AVG({_nut_sql('dm.total_nutrition', 'fiber_g', False)}) AS avg_fiber
    FROM ({DAILY}) dm JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id
    WHERE dm.meal_date >= DATE '{AS_OF}' - 28 GROUP BY 1, 2)) WHERE rn <= 4"""


def _r(df, digits=4):
    """Round double columns for a stable comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _recent(spark, d, weeks=4):
    """Days of the trailing weeks and the plans, from orders that reach into them."""
    since = (dt.date.fromisoformat(AS_OF) - dt.timedelta(weeks=weeks)).isoformat()
    return an.daily_meals(spark, d, since), an.meal_plans(spark, d)


@register("weekly_averages", f"""SELECT user_id, week_start, round(avg_calories, 4) AS avg_calories,
  round(avg_protein, 4) AS avg_protein, round(avg_carbs, 4) AS avg_carbs, round(avg_fat, 4) AS avg_fat,
  round(avg_fiber, 4) AS avg_fiber FROM ({WEEKLY_SQL})""")
def q_weekly_averages(spark, d):
    daily, plans = _recent(spark, d)
    return _r(ml.weekly_averages(daily, plans, AS_OF))


@register("week_over_week_delta", f"""WITH w AS (SELECT user_id, week_start,
    COALESCE(avg_calories, 0.0) AS c, COALESCE(avg_protein, 0.0) AS p, COALESCE(avg_carbs, 0.0) AS cb,
    COALESCE(avg_fat, 0.0) AS f, COALESCE(avg_fiber, 0.0) AS fb,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY week_start DESC) AS rn FROM ({WEEKLY_SQL}))
SELECT a.user_id, a.week_start, round(a.c - b.c, 4) AS delta_calories, round(a.p - b.p, 4) AS delta_protein,
  round(a.cb - b.cb, 4) AS delta_carbs, round(a.f - b.f, 4) AS delta_fat, round(a.fb - b.fb, 4) AS delta_fiber
FROM w a JOIN w b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2""")
def q_week_over_week_delta(spark, d):
    daily, plans = _recent(spark, d)
    return _r(ml.week_over_week_delta(ml.weekly_averages(daily, plans, AS_OF)))


@register("day_totals", f"""SELECT meal_id, {', '.join('round(SUM(' + _nut_sql('nutrition', f) + '), 1) AS ' + f for f in jsonfn.NUTRITION_FIELDS)}
FROM ({DETAILS}) GROUP BY meal_id""")
def q_day_totals(spark, d):
    return ml.day_totals(an.meal_details(spark, d))


@register("plan_week_average", f"""SELECT plan_id, CAST(COUNT(*) AS BIGINT) AS n_days,
  {', '.join('round(SUM(' + _nut_sql('total_nutrition', f) + ') / COUNT(*), 4) AS avg_' + f for f in jsonfn.NUTRITION_FIELDS)}
FROM ({DAILY}) GROUP BY plan_id""")
def q_plan_week_average(spark, d):
    return _r(ml.plan_week_average(an.daily_meals(spark, d)))


@register("latest_active_plan", f"""SELECT user_id, plan_id, start_date, created_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, plan_id DESC) AS rn
  FROM ({PLANS}) WHERE status = 'ACTIVE') WHERE rn = 1""")
def q_latest_active_plan(spark, d):
    return ml.latest_active_plan(an.meal_plans(spark, d)).select("user_id", "plan_id", "start_date", "created_at")


@register("recent_plans", f"""SELECT user_id, plan_id, created_at, CAST(rn AS INTEGER) AS recency_rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, plan_id DESC) AS rn
  FROM ({PLANS})) WHERE rn <= 5""")
def q_recent_plans(spark, d):
    return ml.recent_plans(an.meal_plans(spark, d)).select("user_id", "plan_id", "created_at", "recency_rank")


@register("next_future_plan", f"""SELECT user_id, arg_min(plan_id, (start_date, plan_id)) AS plan_id,
  min(start_date) AS start_date, arg_min(status, (start_date, plan_id)) AS status
FROM ({PLANS}) WHERE start_date > DATE '{AS_OF}' GROUP BY user_id""")
def q_next_future_plan(spark, d):
    return ml.next_future_plan(an.meal_plans(spark, d), AS_OF)


@register("previous_meals", f"""SELECT user_id, plan_id, day_number, meal_type, detail_id,
  upper(left(meal_type, 1)) || lower(substr(meal_type, 2)) || ': ' || meal_name AS meal_label,
  CAST(rn AS INTEGER) AS meal_rank FROM (
  SELECT dm.user_id, dm.plan_id, dm.day_number, md.meal_type, md.detail_id, md.meal_name,
    ROW_NUMBER() OVER (PARTITION BY dm.user_id ORDER BY mp.created_at DESC, dm.plan_id DESC, dm.day_number,
                       md.meal_type, md.detail_id) AS rn
  FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id JOIN ({PLANS}) mp ON dm.plan_id = mp.plan_id
  WHERE mp.status = 'ACTIVE')
WHERE rn <= 28""")
def q_previous_meals(spark, d):
    return ml.previous_meals(*_frames(spark, d)).select(
        "user_id", "plan_id", "day_number", "meal_type", "detail_id", "meal_label", "meal_rank")


def shopping_lists(spark, d):
    """Two or three lists per plan: one per return flag of the plan's lines."""
    li = table(spark, d, "lineitem")
    return (li.groupBy("l_orderkey", "l_returnflag")
            .agg(F.max("l_shipdate").alias("created_at"), F.round(F.sum("l_extendedprice"), 2).alias("total_estimated_cost"),
                 F.count(F.lit(1)).alias("total_items_to_purchase"))
            .select((F.col("l_orderkey") * 100 + F.ascii("l_returnflag")).alias("list_id"),
                    F.col("l_orderkey").alias("plan_id"), "created_at", "total_estimated_cost",
                    F.col("total_items_to_purchase").cast("long").alias("total_items_to_purchase")))


LISTS_SQL = """SELECT l_orderkey * 100 + ascii(l_returnflag) AS list_id, l_orderkey AS plan_id, max(l_shipdate) AS created_at,
  round(sum(l_extendedprice), 2) AS total_estimated_cost, CAST(COUNT(*) AS BIGINT) AS total_items_to_purchase
FROM lineitem GROUP BY l_orderkey, l_returnflag"""


@register("latest_shopping_list", f"""SELECT list_id, plan_id, plan_user_id, created_at, total_estimated_cost FROM (
  SELECT l.*, p.user_id AS plan_user_id, ROW_NUMBER() OVER (PARTITION BY l.plan_id ORDER BY l.created_at DESC, l.list_id DESC) AS rn
  FROM ({LISTS_SQL}) l JOIN ({PLANS}) p ON l.plan_id = p.plan_id) WHERE rn = 1""")
def q_latest_shopping_list(spark, d):
    return ml.latest_shopping_list(shopping_lists(spark, d), an.meal_plans(spark, d)).select(
        "list_id", "plan_id", "plan_user_id", "created_at", "total_estimated_cost")


@register("completed_plan_status", f"SELECT plan_id, user_id, status FROM ({PLANS}) WHERE status IN ('ACTIVE', 'COMPLETED')")
def q_completed_plan_status(spark, d):
    return ml.completed_plan_status(an.meal_plans(spark, d)).select("plan_id", "user_id", "status")


@register("distinct_plan_count", f"""SELECT user_id, CAST(COUNT(DISTINCT plan_id) AS BIGINT) AS plan_count
  FROM ({PLANS}) WHERE status IN ('ACTIVE', 'COMPLETED') GROUP BY user_id""")
def q_distinct_plan_count(spark, d):
    return ml.distinct_plan_count(an.meal_plans(spark, d))


@register("distinct_plan_days", f"SELECT plan_id, day_number, day_name FROM ({DAILY}) GROUP BY plan_id, day_number, day_name")
def q_distinct_plan_days(spark, d):
    return ml.distinct_plan_days(an.daily_meals(spark, d))


@register("daily_schedule_text", f"""SELECT meal_id, plan_id, day_number,
  string_agg(upper(left(meal_type, 1)) || lower(substr(meal_type, 2)) || ': ' || meal_name, ', '
    ORDER BY COALESCE(CASE meal_type WHEN 'breakfast' THEN 1 WHEN 'lunch' THEN 2 WHEN 'snacks' THEN 3
      WHEN 'dinner' THEN 4 END, 99), meal_type, meal_name) AS schedule_text,
  CAST(COUNT(*) AS BIGINT) AS n_meals
FROM (SELECT dm.meal_id, dm.plan_id, dm.day_number, md.meal_type, md.meal_name
      FROM ({DAILY}) dm JOIN ({DETAILS}) md ON dm.meal_id = md.meal_id) GROUP BY meal_id, plan_id, day_number""")
def q_daily_schedule_text(spark, d):
    daily, det, _ = _frames(spark, d)
    return ml.daily_schedule_text(daily, det)


@register("meal_type_order", f"""SELECT detail_id, meal_type,
  CASE meal_type WHEN 'breakfast' THEN 1 WHEN 'lunch' THEN 2 WHEN 'snacks' THEN 3 WHEN 'dinner' THEN 4 END AS meal_type_rank
  FROM ({DETAILS})""")
def q_meal_type_order(spark, d):
    det = an.meal_details(spark, d)
    return (det.select("detail_id", "meal_type", ml.meal_type_rank(F.col("meal_type")).alias("meal_type_rank"))
            .orderBy(F.col("meal_type_rank").asc_nulls_last(), "detail_id"))


@register("sort_multi", f"""SELECT plan_id, day_number, meal_type, detail_id FROM ({DETAILS})""")
def q_sort_multi(spark, d):
    # O2: day_number, meal_type (range-partitioned global sort; order is the feature)
    return (an.meal_details(spark, d).select("plan_id", "day_number", "meal_type", "detail_id")
            .orderBy("plan_id", "day_number", "meal_type", "detail_id"))


@register("concat_batches", f"""SELECT meal_id, plan_id, day_number FROM ({DAILY}) WHERE day_number <= 4
  UNION ALL SELECT meal_id, plan_id, day_number FROM ({DAILY}) WHERE day_number >= 5""")
def q_concat_batches(spark, d):
    daily = an.daily_meals(spark, d).select("meal_id", "plan_id", "day_number")
    return ml.concat_batches(daily.where("day_number <= 4"), daily.where("day_number >= 5"))
