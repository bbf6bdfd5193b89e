"""Nutrition targets, unit conversion, alerts and goal progress (D1-D4,
D12-D14, D36, D37, J16, J18). Pure column arithmetic; small code tables are
literal and therefore broadcast with a size known at plan time.

Python's ``round`` (half-even on the exact double) is reproduced by ``pyround``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.mathfn import pyround

# Activity level -> calorie multiplier (unknown levels use 1.2).
ACTIVITY_MULTIPLIERS = [
    ("Sedentary", 1.2),
    ("Lightly active", 1.375),
    ("Moderately active", 1.55),
    ("Very active", 1.725),
    ("Extremely active", 1.9),
]
DEFAULT_MULTIPLIER = 1.2
# BMR coefficients (intercept, weight, height, age) by sex.
BMR_MALE = (88.362, 13.397, 4.799, 5.677)
BMR_FEMALE = (447.593, 9.247, 3.098, 4.330)
# Diet presets (name, calorie_limit, carb_limit, protein_target).
DIET_PRESETS = [
    ("balanced", 2000, 200, 100),
    ("low_carb", 1800, 100, 120),
    ("high_protein", 2200, 180, 150),
    ("weight_loss", 1500, 150, 90),
    ("vegetarian", 2000, 220, 80),
]


def activity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIVITY_MULTIPLIERS, "activity_level string, multiplier double")


def activity_dim_join(users: DataFrame, spark: SparkSession) -> DataFrame:
    """Activity level -> multiplier, default 1.2 (literal 5-row table,
    broadcast: its size is fixed)."""
    return (users.join(F.broadcast(activity_dim(spark)), "activity_level", "left")
            .withColumn("multiplier", F.coalesce(F.col("multiplier"), F.lit(DEFAULT_MULTIPLIER))))


def nutrition_targets(users: DataFrame, spark: SparkSession) -> DataFrame:
    """BMI, BMR (Harris-Benedict), calories truncated, goal offset,
    protein 1.6 g/kg, fat 25 %, carbs the rest, fiber 30."""
    u = activity_dim_join(users, spark)
    w, h, a = F.col("weight_kg"), F.col("height_cm"), F.col("age")
    male = F.col("gender") == "Male"
    bmr = F.when(male, BMR_MALE[0] + BMR_MALE[1] * w + BMR_MALE[2] * h - BMR_MALE[3] * a) \
        .otherwise(BMR_FEMALE[0] + BMR_FEMALE[1] * w + BMR_FEMALE[2] * h - BMR_FEMALE[3] * a)
    base = (bmr * F.col("multiplier")).cast("int")
    goal = F.col("health_goal")
    cal = (F.when(goal == "Weight Loss", base - 500)
           .when(goal.isin("Weight Gain", "Muscle Gain"), base + 500).otherwise(base))
    u = u.withColumn("bmi", pyround(w / ((h / 100) * (h / 100)), 1)) \
         .withColumn("daily_calories", cal.cast("int")) \
         .withColumn("daily_protein", pyround(w * 1.6, 1))
    u = u.withColumn("daily_fat", pyround(F.col("daily_calories") * 0.25 / 9, 1))
    u = u.withColumn("daily_carbohydrate", pyround(
        (F.col("daily_calories") - F.col("daily_protein") * 4 - F.col("daily_fat") * 9) / 4, 1))
    return u.withColumn("daily_fiber", F.lit(30).cast("int"))


def bmi_category(bmi: Column) -> Column:
    """Bands on a numeric or text BMI; unparsable -> Unknown."""
    v = bmi.try_cast("double")
    return (F.when(v.isNull(), F.lit("Unknown"))
            .when(v < 18.5, F.lit("Underweight")).when(v < 25, F.lit("Normal Weight"))
            .when(v < 30, F.lit("Overweight")).otherwise(F.lit("Obese")))


def unit_system_conversion(height_cm: Column, weight_kg: Column) -> list[Column]:
    """D3: cm -> whole feet and inches (floored), kg -> whole lbs."""
    inches_total = height_cm / 2.54
    return [F.floor(inches_total / 12).cast("int").alias("feet"),
            F.floor(F.pmod(inches_total, F.lit(12.0))).cast("int").alias("inches"),
            (weight_kg * 2.20462).cast("int").alias("lbs")]


def parse_dri_value(text: Column) -> Column:
    """Number text with thousands commas; a range gives its lower bound;
    anything unparsable gives 0."""
    part = F.when(F.contains(text, F.lit("-")), F.split(text, "-", 2)[0]).otherwise(text)
    first = F.split(F.trim(part), r"\s+", 2)[0]
    return F.coalesce(F.regexp_replace(first, ",", "").try_cast("double"), F.lit(0.0))


def plan_target_join(day_totals: DataFrame, targets: DataFrame) -> DataFrame:
    """Day totals (with user_id) JOIN user targets."""
    t = targets.select("user_id", "daily_calories", "daily_protein", "daily_carbohydrate",
                       "daily_fat", "daily_fiber")
    return day_totals.join(t, "user_id", "inner")


def nutrition_alerts(joined: DataFrame) -> DataFrame:
    """Alert rows per day: calories > +10 % (alert and suggestion),
    < -20 %; protein < -20 %; carbs > +20 %; fat > +20 %. Percentages are
    truncated; a target <= 0 skips the check. Input: J18 output with
    calories, protein_g, carbohydrates_g, fat_g (missing -> 0)."""
    cal = F.coalesce(F.col("calories"), F.lit(0.0))
    tc = F.col("daily_calories")
    diff = cal - tc
    pct = F.when(tc > 0, F.try_divide(diff, tc) * 100).otherwise(F.lit(0.0))
    prot = F.coalesce(F.col("protein_g"), F.lit(0.0))
    carb = F.coalesce(F.col("carbohydrates_g"), F.lit(0.0))
    fat = F.coalesce(F.col("fat_g"), F.lit(0.0))
    tp, tcb, tf = F.col("daily_protein"), F.col("daily_carbohydrate"), F.col("daily_fat")

    def alert(cond, kind, msg):
        return F.when(cond, F.struct(F.lit(kind).alias("alert_type"), msg.alias("message")))

    alerts = F.array_compact(F.array(
        alert(pct > 10, "calorie_over", F.format_string("over by %d kcal (%d%%)", diff.cast("int"), pct.cast("int"))),
        alert(pct > 10, "calorie_suggestion", F.lit("lighter dinner or skip a snack")),
        alert(pct < -20, "calorie_under", F.format_string("under by %d kcal", F.abs(diff).cast("int"))),
        alert((tp > 0) & (F.try_divide(prot - tp, tp) < -0.2), "protein_low",
              F.format_string("%dg vs %dg", prot.cast("int"), tp.cast("int"))),
        alert((tcb > 0) & (F.try_divide(carb - tcb, tcb) > 0.2), "carbs_high", F.lit("high carbohydrate intake")),
        alert((tf > 0) & (F.try_divide(fat - tf, tf) > 0.2), "fat_high", F.lit("high fat intake")),
    ))
    keys = [c for c in ("user_id", "meal_id", "meal_date") if c in joined.columns]
    return (joined.select(*keys, F.explode(alerts).alias("a"))
            .select(*keys, "a.alert_type", "a.message"))


def goal_progress(actual: Column, target: Column) -> tuple[Column, Column]:
    """(percent capped at 100, band). Target 0 -> 0 % and band 'none'."""
    ratio = F.try_divide(actual, target)
    pct = F.when(target.isNull() | (target == 0), F.lit(0.0)).otherwise(F.least(ratio * 100, F.lit(100.0)))
    band = (F.when(target.isNull() | (target == 0), F.lit("none"))
            .when(ratio > 1.0, F.lit("above")).when(ratio >= 0.95, F.lit("on_target"))
            .otherwise(F.lit("below")))
    return pct, band


def macro_energy_pct(protein: Column, fat: Column, carbs: Column, energy: Column) -> list[Column]:
    """Share of energy from each macro (4/9/4 kcal per g), 1 decimal."""
    def pct(g, k):
        return F.round(F.try_divide(g * k, energy) * 100, 1)
    return [pct(protein, 4).alias("protein_pct"), pct(fat, 9).alias("fat_pct"),
            pct(carbs, 4).alias("carbs_pct")]


def preset_compliance(day_totals: DataFrame) -> DataFrame:
    """Each day against the 5 presets. The presets are a literal array
    exploded per row (5 rows per day), not a join."""
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(c).alias("calorie_limit"),
                                 F.lit(cb).alias("carb_limit"), F.lit(p).alias("protein_target"))
                        for n, c, cb, p in DIET_PRESETS])
    x = day_totals.withColumn("p", F.explode(presets))
    cal = F.coalesce(F.col("calories"), F.lit(0.0))
    carb = F.coalesce(F.col("carbohydrates_g"), F.lit(0.0))
    prot = F.coalesce(F.col("protein_g"), F.lit(0.0))
    return x.select(*[c for c in day_totals.columns if c in ("user_id", "meal_id", "meal_date")],
                    F.col("p.preset").alias("preset"),
                    (cal <= F.col("p.calorie_limit")).alias("calories_within"),
                    (carb <= F.col("p.carb_limit")).alias("carbs_within"),
                    (prot >= F.col("p.protein_target")).alias("protein_met"),
                    ((cal <= F.col("p.calorie_limit")) & (carb <= F.col("p.carb_limit"))).alias("within_limits"))


def merge_profile_update(users: DataFrame, updates: DataFrame, spark: SparkSession) -> DataFrame:
    """Apply new profile values by user (NULL in the update keeps the
    old value) and recompute the targets."""
    cols = [c for c in updates.columns if c != "user_id"]
    u = updates.select("user_id", *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = users.join(u, "user_id", "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return nutrition_targets(j, spark)
