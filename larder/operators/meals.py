"""Meal-plan queries, answered for all users at once (set-based forms of the
per-user lookups). Callers filter the result by user when they need one.

Join order for the three-way join: daily x plan first (both keyed by plan),
then the largest table, meal details, joins once on meal_id, so it is
shuffled exactly one time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import jsonfn

# Presentation order of meal types (unknown types sort last).
MEAL_TYPE_ORDER = ["breakfast", "lunch", "snacks", "dinner"]


def meal_type_rank(c: Column) -> Column:
    """O1: breakfast 1, lunch 2, snacks 3, dinner 4, others NULL."""
    expr = None
    for i, t in enumerate(MEAL_TYPE_ORDER, start=1):
        expr = F.when(c == t, F.lit(i)) if expr is None else expr.when(c == t, F.lit(i))
    return expr


def meals_three_way(daily: DataFrame, details: DataFrame, plans: DataFrame,
                    plan_filter: Column | None = None) -> DataFrame:
    """Daily JOIN details JOIN plans (inner equi-joins).

    ``plan_filter`` is applied to the plan side before the join so that it
    reaches the plan scan and shrinks the join inputs.
    """
    p = plans.select("plan_id", F.col("status").alias("plan_status"),
                     F.col("user_id").alias("plan_user_id"), "start_date", "end_date", "created_at")
    if plan_filter is not None:
        p = p.where(plan_filter)
    dp = daily.join(p, "plan_id", "inner")
    return dp.join(details.drop("plan_id", "day_number"), "meal_id", "inner")


def meals_by_criteria(daily, details, plans, day_number=None, meal_type=None,
                      meal_date=None, user_id=None) -> DataFrame:
    """P10: meals of ACTIVE plans with optional day, date, type (and user)."""
    j = meals_three_way(daily, details, plans, F.col("plan_status") == "ACTIVE")
    cond = F.lit(True)
    if user_id is not None:
        cond = cond & (F.col("user_id") == user_id)
    if day_number is not None:
        cond = cond & (F.col("day_number") == day_number)
    if meal_date is not None:
        cond = cond & (F.col("meal_date") == F.lit(meal_date).cast("date"))
    if meal_type is not None:
        cond = cond & (F.col("meal_type") == meal_type)
    return j.where(cond)


def meals_by_date(daily, details, plans, meal_date=None, meal_type=None) -> DataFrame:
    """With a date any plan status; without one only ACTIVE plans; the
    meal type is compared lower-cased. The user comes from the plan."""
    pf = None if meal_date else (F.col("plan_status") == "ACTIVE")
    j = meals_three_way(daily, details, plans, pf)
    if meal_date:
        j = j.where(F.col("meal_date") == F.lit(meal_date).cast("date"))
    if meal_type:
        j = j.where(F.col("meal_type") == meal_type.lower())
    return j.withColumn("user_id", F.col("plan_user_id"))


def meals_by_type(daily, details, plans, meal_type: str) -> DataFrame:
    """Every meal of one type from ACTIVE plans."""
    return meals_by_criteria(daily, details, plans, meal_type=meal_type)


def meals_with_ingredient(daily, details, plans, query: str) -> DataFrame:
    """Meals with an ingredient containing ``query`` (case-insensitive);
    returns the first matching ingredient of the array."""
    j = meals_three_way(daily, details, plans, F.col("plan_status") == "ACTIVE")
    ings = jsonfn.parse(F.col("ingredients"), jsonfn.INGREDIENTS)
    q = query.lower()
    hits = F.filter(ings, lambda x: F.contains(F.lower(F.coalesce(x["ingredient"], F.lit(""))), F.lit(q)))
    return (j.withColumn("_hits", hits).where(F.size("_hits") > 0)
            .withColumn("matching_ingredient", F.col("_hits")[0]["ingredient"]).drop("_hits"))


def trailing_weeks(c: Column, as_of: str, weeks: int) -> Column:
    """``c >= as_of - 7*weeks days``."""
    return c >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks)


def plan_week_details(daily: DataFrame, details: DataFrame) -> DataFrame:
    """Daily JOIN details (all days of each plan), type order O1."""
    return (daily.join(details.drop("plan_id", "day_number"), "meal_id", "inner")
            .withColumn("meal_type_rank", meal_type_rank(F.col("meal_type"))))


def nutrition_history(daily: DataFrame, plans: DataFrame, as_of: str, weeks: int = 4) -> DataFrame:
    """Days of the trailing ``weeks`` with their plan dates; nutrition
    fields read from JSON with missing -> 0 as the dashboard does."""
    p = plans.select("plan_id", "start_date", "end_date")
    j = daily.where(trailing_weeks(F.col("meal_date"), as_of, weeks)).join(p, "plan_id", "inner")
    n = jsonfn.nutrition("total_nutrition")
    return j.select("user_id", "plan_id", "start_date", "end_date", "meal_date",
                    *[F.coalesce(n[f], F.lit(0.0)).alias(f) for f in jsonfn.NUTRITION_FIELDS])


def weekly_averages(daily: DataFrame, plans: DataFrame, as_of: str, weeks: int = 4,
                    newest: int = 4) -> DataFrame:
    """A5: per user and Monday-based week, the mean of five JSON fields over
    the trailing weeks; newest ``newest`` weeks per user (NULL kept as NULL,
    AVG ignores it)."""
    p = plans.select("plan_id")
    j = daily.where(trailing_weeks(F.col("meal_date"), as_of, weeks)).join(p, "plan_id", "inner")
    n = jsonfn.nutrition("total_nutrition")
    wk = F.date_trunc("week", F.col("meal_date").cast("timestamp")).cast("date")
    agg = (j.select("user_id", wk.alias("week_start"), n.alias("n"))
           .groupBy("user_id", "week_start")
           .agg(F.avg("n.calories").alias("avg_calories"), F.avg("n.protein_g").alias("avg_protein"),
                F.avg("n.carbohydrates_g").alias("avg_carbs"), F.avg("n.fat_g").alias("avg_fat"),
                F.avg("n.fiber_g").alias("avg_fiber")))
    w = Window.partitionBy("user_id").orderBy(F.col("week_start").desc())
    return agg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest).drop("_rn")


def week_over_week_delta(weekly: DataFrame) -> DataFrame:
    """Newest week minus the one before it, per user (NULL -> 0 first)."""
    cols = ["avg_calories", "avg_protein", "avg_carbs", "avg_fat", "avg_fiber"]
    w = Window.partitionBy("user_id").orderBy(F.col("week_start").desc())
    z = weekly.select("user_id", "week_start", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    z = z.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        z = z.withColumn(f"prev_{c}", F.lead(c).over(w))
    out = z.where((F.col("_rn") == 1) & F.col("prev_avg_calories").isNotNull())
    return out.select("user_id", "week_start",
                      *[(F.col(c) - F.col(f"prev_{c}")).alias(c.replace("avg_", "delta_")) for c in cols])


def day_totals(details: DataFrame, key_cols=("meal_id",)) -> DataFrame:
    """Per day the sum of five nutrition fields (missing -> 0), 1 decimal."""
    n = jsonfn.nutrition("nutrition")
    return (details.select(*key_cols, n.alias("n"))
            .groupBy(*key_cols)
            .agg(*[F.round(F.sum(F.coalesce(F.col(f"n.{f}"), F.lit(0.0))), 1).alias(f)
                   for f in jsonfn.NUTRITION_FIELDS]))


def plan_week_average(daily: DataFrame) -> DataFrame:
    """Per plan, sum of day totals / number of day rows (rows without
    nutrition still count in the divisor)."""
    n = jsonfn.nutrition("total_nutrition")
    d = daily.select("plan_id", n.alias("n"))
    return d.groupBy("plan_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_days"),
        *[(F.sum(F.coalesce(F.col(f"n.{f}"), F.lit(0.0))) / F.count(F.lit(1))).alias(f"avg_{f}")
          for f in jsonfn.NUTRITION_FIELDS])


def latest_by(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """Newest-n per key via row_number (planned as WindowGroupLimit: the
    limit is applied per map task before the shuffle, so hot keys are cheap)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def latest_active_plan(plans: DataFrame) -> DataFrame:
    """Newest ACTIVE plan per user (tie: higher plan_id)."""
    a = plans.where(F.col("status") == "ACTIVE")
    return latest_by(a, "user_id", [F.col("created_at").desc(), F.col("plan_id").desc()]).drop("_rn")


def recent_plans(plans: DataFrame, limit: int = 5) -> DataFrame:
    """Newest ``limit`` plans per user."""
    return (latest_by(plans, "user_id", [F.col("created_at").desc(), F.col("plan_id").desc()], limit)
            .withColumnRenamed("_rn", "recency_rank"))


def next_future_plan(plans: DataFrame, as_of: str) -> DataFrame:
    """Earliest plan starting after ``as_of`` per user (min_by: one
    partial aggregate per task, no sort of the user's plans)."""
    f = plans.where(F.col("start_date") > F.lit(as_of).cast("date"))
    best = F.min_by(F.struct("start_date", "plan_id", "status"),
                    F.struct("start_date", "plan_id"))
    return f.groupBy("user_id").agg(best.alias("p")).select(
        "user_id", "p.plan_id", "p.start_date", "p.status")


def previous_meals(daily, details, plans, limit: int = 28) -> DataFrame:
    """The user's ``limit`` most recent meals of ACTIVE plans as ``Type:
    name``, newest plan first, then day and meal type; a per-user top-k."""
    j = meals_three_way(daily, details, plans.where(F.col("status") == "ACTIVE"))
    label = F.concat(F.upper(F.substring("meal_type", 1, 1)), F.lower(F.expr("substring(meal_type, 2)")),
                     F.lit(": "), F.col("meal_name"))
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("plan_id").desc(),
                                              F.col("day_number").asc(), F.col("meal_type").asc(),
                                              F.col("detail_id").asc())
    return (j.select("user_id", "plan_id", "day_number", "meal_type", "detail_id", "created_at",
                     label.alias("meal_label"))
            .withColumn("meal_rank", F.row_number().over(w)).where(F.col("meal_rank") <= limit))


def latest_shopping_list(lists: DataFrame, plans: DataFrame) -> DataFrame:
    """Lists JOIN plans, newest list per plan (tie: higher list_id)."""
    j = lists.join(plans.select("plan_id", F.col("user_id").alias("plan_user_id"), "status"), "plan_id")
    return latest_by(j, "plan_id", [F.col("created_at").desc(), F.col("list_id").desc()]).drop("_rn")


def completed_plan_status(plans: DataFrame) -> DataFrame:
    """P22."""
    return plans.where(F.col("status").isin("ACTIVE", "COMPLETED"))


def distinct_plan_count(plans: DataFrame) -> DataFrame:
    """Distinct ACTIVE/COMPLETED plans per user."""
    return (completed_plan_status(plans).groupBy("user_id")
            .agg(F.countDistinct("plan_id").cast("long").alias("plan_count")))


def distinct_plan_days(daily: DataFrame) -> DataFrame:
    """GROUP BY plan, day number, day name without aggregates."""
    return daily.select("plan_id", "day_number", "day_name").distinct()


def daily_schedule_text(daily: DataFrame, details: DataFrame) -> DataFrame:
    """Per day ``Type: name`` joined with ', ' in meal-type order.

    A day holds a handful of meals, so collecting it is bounded; the sort
    key makes the text independent of arrival order.
    """
    j = daily.join(details.drop("plan_id", "day_number"), "meal_id")
    rank = F.coalesce(meal_type_rank(F.col("meal_type")), F.lit(99))
    label = F.concat(F.initcap("meal_type"), F.lit(": "), F.col("meal_name"))
    g = (j.groupBy("meal_id", "plan_id", "day_number")
         .agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("meal_type").alias("t"),
                                                   F.col("meal_name").alias("n"),
                                                   label.alias("label")))).alias("items")))
    return g.select("meal_id", "plan_id", "day_number",
                    F.array_join(F.transform("items", lambda x: x["label"]), ", ").alias("schedule_text"),
                    F.size("items").cast("long").alias("n_meals"))


def concat_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Days 1-4 followed by days 5-7 (union by name, no dedupe)."""
    return first.unionByName(second)
