"""Nutrition-target, alert and progress queries over customer/day analogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import jsonfn
from larder.functions.mathfn import pyround_sql as pyround
from larder.operators import nutrition as nu
from larder.plans import analogues as an
from larder.plans.registry import register

USERS = an.USERS_SQL
ACT_SQL = "(VALUES " + ", ".join(f"('{a}', {m}::DOUBLE)" for a, m in nu.ACTIVITY_MULTIPLIERS) + ") AS a(activity_level, multiplier)"


def targets_sql(users_sql: str = USERS) -> str:
    return f"""WITH j AS (SELECT u.*, COALESCE(a.multiplier, 1.2::DOUBLE) AS multiplier FROM ({users_sql}) u LEFT JOIN {ACT_SQL} USING (activity_level)),
b AS (SELECT *, CASE WHEN gender = 'Male' THEN 88.362::DOUBLE + 13.397::DOUBLE * weight_kg + 4.799::DOUBLE * height_cm - 5.677::DOUBLE * age
  ELSE 447.593::DOUBLE + 9.247::DOUBLE * weight_kg + 3.098::DOUBLE * height_cm - 4.330::DOUBLE * age END AS bmr FROM j),
c AS (SELECT *, CAST(trunc(bmr * multiplier) AS INTEGER) AS base FROM b),
d AS (SELECT *, CAST(CASE WHEN health_goal = 'Weight Loss' THEN base - 500 WHEN health_goal IN ('Weight Gain', 'Muscle Gain') THEN base + 500
  ELSE base END AS INTEGER) AS daily_calories, {pyround('weight_kg * 1.6::DOUBLE', 1)} AS daily_protein,
  {pyround('weight_kg / ((height_cm / 100) * (height_cm / 100))', 1)} AS bmi FROM c),
e AS (SELECT *, {pyround('daily_calories * 0.25::DOUBLE / 9', 1)} AS daily_fat FROM d)
SELECT *, {pyround('(daily_calories - daily_protein * 4 - daily_fat * 9) / 4', 1)} AS daily_carbohydrate,
  30 AS daily_fiber FROM e"""


TARGET_COLS = ["user_id", "multiplier", "bmi", "daily_calories", "daily_protein", "daily_fat",
               "daily_carbohydrate", "daily_fiber"]


@register("nutrition_targets", f"SELECT {', '.join(TARGET_COLS)} FROM ({targets_sql()})")
def q_nutrition_targets(spark, d):
    return nu.nutrition_targets(an.users(spark, d), spark).select(*TARGET_COLS)


@register("activity_dim_join", f"""SELECT u.user_id, u.activity_level, COALESCE(a.multiplier, 1.2::DOUBLE) AS multiplier
  FROM ({USERS}) u LEFT JOIN {ACT_SQL} USING (activity_level)""")
def q_activity_dim_join(spark, d):
    return nu.activity_dim_join(an.users(spark, d), spark).select("user_id", "activity_level", "multiplier")


@register("bmi_category", f"""SELECT user_id, CASE WHEN b IS NULL THEN 'Unknown' WHEN b < 18.5 THEN 'Underweight'
  WHEN b < 25 THEN 'Normal Weight' WHEN b < 30 THEN 'Overweight' ELSE 'Obese' END AS bmi_category
FROM (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE bmi END AS b FROM ({targets_sql()}))""")
def q_bmi_category(spark, d):
    t = nu.nutrition_targets(an.users(spark, d), spark)
    txt = F.when(F.col("user_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("bmi").cast("string"))
    return t.select("user_id", nu.bmi_category(txt).alias("bmi_category"))


@register("unit_system_conversion", f"""SELECT user_id, CAST(floor(height_cm / 2.54 / 12) AS INTEGER) AS feet,
  CAST(floor(fmod(height_cm / 2.54, 12.0)) AS INTEGER) AS inches, CAST(trunc(weight_kg * 2.20462) AS INTEGER) AS lbs
FROM ({USERS})""")
def q_unit_system_conversion(spark, d):
    u = an.users(spark, d)
    return u.select("user_id", *nu.unit_system_conversion(F.col("height_cm"), F.col("weight_kg")))


def _dri_text(col_key, col_nat):
    return (F.when(col_key % 3 == 0, F.concat(col_nat.cast("string"), F.lit(","),
                                                F.lpad((col_key % 1000).cast("string"), 3, "0"), F.lit(" kcal/day")))
            .when(col_key % 3 == 1, F.concat(col_nat.cast("string"), F.lit(" - "), (col_nat + 10).cast("string"), F.lit(" g")))
            .otherwise(F.lit("n/a")))


@register("parse_dri_value", """SELECT c_custkey AS user_id, COALESCE(TRY_CAST(replace(
  string_split_regex(trim(CASE WHEN contains(t, '-') THEN split_part(t, '-', 1) ELSE t END), '\\s+')[1], ',', '') AS DOUBLE), 0.0) AS dri_value
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) || ',' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' kcal/day'
  WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS VARCHAR) || ' - ' || CAST(c_nationkey + 10 AS VARCHAR) || ' g' ELSE 'n/a' END AS t FROM customer)""")
def q_parse_dri_value(spark, d):
    from larder.sources.tables import table
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"),
                    nu.parse_dri_value(_dri_text(F.col("c_custkey"), F.col("c_nationkey"))).alias("dri_value"))


def day_nutrition(daily):
    """Valid day totals only (NULL or malformed JSON -> no row), missing key -> 0."""
    n = jsonfn.nutrition("total_nutrition")
    return (daily.where(F.col("total_nutrition").isNotNull() & F.try_parse_json("total_nutrition").isNotNull())
            .select("user_id", "meal_id", "meal_date",
                    *[F.coalesce(n[f], F.lit(0.0)).alias(f) for f in jsonfn.NUTRITION_FIELDS]))


def _nf(f):
    return f"COALESCE(CAST(json_extract(total_nutrition, '$.{f}') AS DOUBLE), 0.0) AS {f}"


DAY_NUT_SQL = f"""SELECT user_id, meal_id, meal_date, {', '.join(_nf(f) for f in jsonfn.NUTRITION_FIELDS)}
FROM ({an.DAILY_MEALS_SQL}) WHERE total_nutrition IS NOT NULL AND json_valid(total_nutrition)"""
J18_SQL = f"""SELECT d.*, t.daily_calories, t.daily_protein, t.daily_carbohydrate, t.daily_fat, t.daily_fiber
FROM ({DAY_NUT_SQL}) d JOIN ({targets_sql()}) t ON d.user_id = t.user_id"""


def _j18(spark, d):
    return nu.plan_target_join(day_nutrition(an.daily_meals(spark, d)),
                               nu.nutrition_targets(an.users(spark, d), spark))


@register("plan_target_join", f"SELECT user_id, meal_id, calories, protein_g, daily_calories, daily_protein FROM ({J18_SQL})")
def q_plan_target_join(spark, d):
    return _j18(spark, d).select("user_id", "meal_id", "calories", "protein_g", "daily_calories", "daily_protein")


@register("nutrition_alerts", f"""WITH j AS (SELECT *, calories - daily_calories AS diff,
  CASE WHEN daily_calories > 0 THEN (calories - daily_calories) / daily_calories * 100 ELSE 0.0 END AS pct FROM ({J18_SQL}))
SELECT user_id, meal_id, meal_date, 'calorie_over' AS alert_type,
  printf('over by %d kcal (%d%%)', CAST(trunc(diff) AS INTEGER), CAST(trunc(pct) AS INTEGER)) AS message FROM j WHERE pct > 10
UNION ALL SELECT user_id, meal_id, meal_date, 'calorie_suggestion', 'lighter dinner or skip a snack' FROM j WHERE pct > 10
UNION ALL SELECT user_id, meal_id, meal_date, 'calorie_under', printf('under by %d kcal', CAST(trunc(abs(diff)) AS INTEGER)) FROM j WHERE pct < -20
UNION ALL SELECT user_id, meal_id, meal_date, 'protein_low', printf('%dg vs %dg', CAST(trunc(protein_g) AS INTEGER), CAST(trunc(daily_protein) AS INTEGER))
  FROM j WHERE daily_protein > 0 AND (protein_g - daily_protein) / daily_protein < -0.2
UNION ALL SELECT user_id, meal_id, meal_date, 'carbs_high', 'high carbohydrate intake' FROM j
  WHERE daily_carbohydrate > 0 AND (carbohydrates_g - daily_carbohydrate) / daily_carbohydrate > 0.2
UNION ALL SELECT user_id, meal_id, meal_date, 'fat_high', 'high fat intake' FROM j WHERE daily_fat > 0 AND (fat_g - daily_fat) / daily_fat > 0.2""")
def q_nutrition_alerts(spark, d):
    return nu.nutrition_alerts(_j18(spark, d))


@register("goal_progress", f"""SELECT user_id, meal_id,
  round(CASE WHEN daily_calories = 0 THEN 0.0 ELSE least(calories / daily_calories * 100, 100.0) END, 4) AS calories_pct,
  CASE WHEN daily_calories = 0 THEN 'none' WHEN calories / daily_calories > 1.0 THEN 'above'
       WHEN calories / daily_calories >= 0.95 THEN 'on_target' ELSE 'below' END AS calories_band,
  round(CASE WHEN daily_protein = 0 THEN 0.0 ELSE least(protein_g / daily_protein * 100, 100.0) END, 4) AS protein_pct,
  CASE WHEN daily_protein = 0 THEN 'none' WHEN protein_g / daily_protein > 1.0 THEN 'above'
       WHEN protein_g / daily_protein >= 0.95 THEN 'on_target' ELSE 'below' END AS protein_band
FROM ({J18_SQL})""")
def q_goal_progress(spark, d):
    j = _j18(spark, d)
    cp, cb = nu.goal_progress(F.col("calories"), F.col("daily_calories"))
    pp, pb = nu.goal_progress(F.col("protein_g"), F.col("daily_protein"))
    return j.select("user_id", "meal_id", F.round(cp, 4).alias("calories_pct"), cb.alias("calories_band"),
                    F.round(pp, 4).alias("protein_pct"), pb.alias("protein_band"))


@register("macro_energy_pct", f"""SELECT fdc_id, round(protein * 4 / calories * 100, 1) AS protein_pct,
  round(total_fat * 9 / calories * 100, 1) AS fat_pct, round(carbohydrate * 4 / calories * 100, 1) AS carbs_pct
FROM ({an.INT_MACRONUTRIENTS_SQL}) WHERE calories IS NOT NULL""")
def q_macro_energy_pct(spark, d):
    m = an.macros(spark, d).where(F.col("calories").isNotNull())
    return m.select("fdc_id", *nu.macro_energy_pct(F.col("protein"), F.col("total_fat"),
                                                   F.col("carbohydrate"), F.col("calories")))


PRESETS_SQL = "(VALUES " + ", ".join(f"('{n}', {c}, {cb}, {p})" for n, c, cb, p in nu.DIET_PRESETS) + \
    ") AS p(preset, calorie_limit, carb_limit, protein_target)"


@register("preset_compliance", f"""SELECT d.user_id, d.meal_id, d.meal_date, p.preset,
  d.calories <= p.calorie_limit AS calories_within, d.carbohydrates_g <= p.carb_limit AS carbs_within,
  d.protein_g >= p.protein_target AS protein_met,
  d.calories <= p.calorie_limit AND d.carbohydrates_g <= p.carb_limit AS within_limits
FROM ({DAY_NUT_SQL}) d, {PRESETS_SQL}""")
def q_preset_compliance(spark, d):
    return nu.preset_compliance(day_nutrition(an.daily_meals(spark, d)))


_UPD_SQL = f"""SELECT user_id, weight_kg + 5 AS weight_kg, 'Weight Loss' AS health_goal FROM ({USERS})
  WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""


@register("merge_profile_update", f"""SELECT user_id, weight_kg, health_goal, daily_calories, daily_protein, daily_fat,
  daily_carbohydrate FROM ({targets_sql(f'''SELECT u.user_id, u.username, u.age, u.gender, u.height_cm,
    COALESCE(x.weight_kg, u.weight_kg) AS weight_kg, u.activity_level, COALESCE(x.health_goal, u.health_goal) AS health_goal,
    u.dietary_restrictions, u.nation_key FROM ({USERS}) u LEFT JOIN ({_UPD_SQL}) x ON u.user_id = x.user_id''')})""")
def q_merge_profile_update(spark, d):
    from larder.sources.tables import table
    u = an.users(spark, d)
    neg = table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    upd = (u.join(neg, "user_id", "left_semi")
           .select("user_id", (F.col("weight_kg") + 5).alias("weight_kg"), F.lit("Weight Loss").alias("health_goal")))
    return nu.merge_profile_update(u, upd, spark).select(
        "user_id", "weight_kg", "health_goal", "daily_calories", "daily_protein", "daily_fat", "daily_carbohydrate")
