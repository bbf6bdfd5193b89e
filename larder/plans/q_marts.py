"""ELT marts over the food analogues: staging, intermediate views, marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import marts as m
from larder.operators import staging as st
from larder.plans import analogues as an
from larder.plans.registry import register

_MEANS = {"avg_calories": "calories", "avg_protein": "protein", "avg_fat": "total_fat", "avg_carbs": "carbohydrate", "avg_fiber": "fiber"}
MART_FOOD_CATEGORIES_SQL = f"""FROM ({an.INT_MACRONUTRIENTS_SQL}) SELECT category, count(DISTINCT fdc_id)::BIGINT AS total_foods,
  {", ".join(f"round(avg({c}), 1) AS {out}" for out, c in _MEANS.items())},
  count(*) FILTER (protein >= 15)::BIGINT AS high_protein_foods, count(*) FILTER (sodium < 140)::BIGINT AS low_sodium_foods
WHERE category IS NOT NULL GROUP BY ALL"""


def _quoted(values):
    return ", ".join("'" + v + "'" for v in values)


def _clean_sql(c):
    """P5: what is NULL, empty or all digits has no category."""
    return f"coalesce(nullif(regexp_replace({c}, '^[0-9]+$', ''), ''), 'Uncategorized')"


def _veg_sql(c):
    """A known category that names no meat."""
    return (f"({c} IS NOT NULL AND {c} NOT IN ({_quoted(m.NON_VEG_CATEGORIES)})"
            f" AND len(list_filter([{_quoted(m.NON_VEG_WORDS)}], lambda w: contains(lower({c}), w))) = 0)")


_FLAG_RULES = {"low_sodium": "sodium < 140", "high_protein": "protein >= 15", "low_carb": "carbohydrate <= 25", "low_fat": "total_fat < 5"}
_FLAGS_SQL = ", ".join(f"coalesce({rule}, FALSE) AS {name}" for name, rule in _FLAG_RULES.items())


def _band_sql(c):
    """Upper bounds in order; the first band is open at its bound."""
    return f"if({c} < 100, 'Very Low', if({c} <= 200, 'Low', if({c} <= 400, 'Moderate', if({c} > 400, 'High', NULL))))"


_COMPLETE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in ("fdc_id", "calories", "protein", "food_name"))
# Most complete first (how many of the two are missing), then the highest id
_BEST_SQL = "row_number() OVER (PARTITION BY food_name ORDER BY (fiber IS NULL)::INT + (sodium IS NULL)::INT, fdc_id DESC) = 1"


@register("mart_food_categories", MART_FOOD_CATEGORIES_SQL)
def q_mart_food_categories(spark, d):
    return m.mart_food_categories(an.macros(spark, d))


AS_OF_TS = "2024-02-01 00:00:00"


@register("stg_food", an.STG_FOOD_SQL)
def q_stg_food(spark, d):
    return st.stg_food(an.raw_food(spark, d))


@register("stg_food_nutrient", an.STG_FOOD_NUTRIENT_SQL.replace(
    "percent_daily_value FROM", f"percent_daily_value, TIMESTAMP '{AS_OF_TS}' AS _loaded_at FROM"))
def q_stg_food_nutrient(spark, d):
    import datetime as dt
    return st.stg_food_nutrient(an.raw_food_nutrient(spark, d),
                                loaded_at=dt.datetime.fromisoformat(AS_OF_TS))


@register("stg_food_portion", f"""SELECT id AS portion_id, fdc_id, portion_description, gram_weight,
  measure_unit_id, TIMESTAMP '{AS_OF_TS}' AS _loaded_at FROM ({an.RAW_FOOD_PORTION_SQL})
  WHERE fdc_id IS NOT NULL AND gram_weight IS NOT NULL AND gram_weight > 0""")
def q_stg_food_portion(spark, d):
    import datetime as dt
    return st.stg_food_portion(an.raw_food_portion(spark, d),
                               loaded_at=dt.datetime.fromisoformat(AS_OF_TS))


@register("stg_nutrient", f"SELECT id AS nutrient_id, trim(name) AS nutrient_name, unit_name, nutrient_nbr, rank_order FROM ({an.RAW_NUTRIENT_USED_SQL})")
def q_stg_nutrient(spark, d):
    return st.stg_nutrient(an.raw_nutrient_used(spark, d))


@register("food_nutrition_complete", f"""WITH facts AS (
  SELECT fdc_id, nutrient_id, name AS nutrient_name, unit_name, amount FROM ({an.RAW_FOOD_NUTRIENT_SQL}) LEFT JOIN ({an.RAW_NUTRIENT_SQL}) c ON c.id = nutrient_id),
  described AS (SELECT fdc_id, description, food_category FROM ({an.RAW_FOOD_SQL}) WHERE description IS NOT NULL)
SELECT * FROM described JOIN facts USING (fdc_id)
UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM described WHERE fdc_id NOT IN (SELECT fdc_id FROM facts)""")
def q_food_nutrition_complete(spark, d):
    return st.food_nutrition_complete(an.raw_food(spark, d), an.raw_food_nutrient(spark, d),
                                      an.raw_nutrient(spark, d))


@register("int_food_nutrition", f"""WITH named AS (SELECT nutrient_id AS code, nutrient_name, unit_name FROM ({an.STG_NUTRIENT_SQL})),
  known AS (SELECT fdc_id, food_name, category, data_type FROM ({an.STG_FOOD_SQL}))
SELECT known.*, nutrient_id, nutrient_name, unit_name, nutrient_amount AS amount_per_100g, data_points, min_value, max_value
FROM ({an.STG_FOOD_NUTRIENT_SQL}) JOIN known USING (fdc_id) LEFT JOIN named ON code = nutrient_id""")
def q_int_food_nutrition(spark, d):
    return st.int_food_nutrition(*an.staged(spark, d))


@register("int_macronutrients", an.INT_MACRONUTRIENTS_SQL)
def q_int_macronutrients(spark, d):
    return an.macros(spark, d)


MART_MEAL_PLANNING_SQL = f"""SELECT fdc_id, food_name, category, data_type, calories, protein, total_fat, carbohydrate, fiber, sodium,
  {_veg_sql("category")} AS vegetarian_friendly, {_FLAGS_SQL}, {_band_sql("calories")} AS calorie_density
FROM (SELECT * REPLACE (lower(trim(food_name)) AS food_name, {_clean_sql("category")} AS category)
      FROM ({an.INT_MACRONUTRIENTS_SQL}) WHERE {_COMPLETE_SQL})
QUALIFY {_BEST_SQL}"""


@register("mart_meal_planning", MART_MEAL_PLANNING_SQL)
def q_mart_meal_planning(spark, d):
    return m.mart_meal_planning(an.macros(spark, d))


# Category cleaning over raw categories, with derived codes so every branch
# (digits-only, digits plus newline, empty, NULL, text) occurs.
_CAT_INPUT_SQL = f"""SELECT fdc_id, CASE WHEN fdc_id % 7 = 0 THEN CAST(fdc_id AS VARCHAR)
  WHEN fdc_id % 7 = 1 THEN CAST(fdc_id AS VARCHAR) || chr(10) WHEN fdc_id % 7 = 2 THEN ''
  WHEN fdc_id % 7 = 3 THEN NULL ELSE food_category END AS category FROM ({an.RAW_FOOD_SQL})"""


def _cat_input(spark, d):
    f = an.raw_food(spark, d)
    k = F.col("fdc_id") % 7
    cat = (F.when(k == 0, F.col("fdc_id").cast("string"))
           .when(k == 1, F.concat(F.col("fdc_id").cast("string"), F.lit("\n")))
           .when(k == 2, F.lit("")).when(k == 3, F.lit(None).cast("string"))
           .otherwise(F.col("food_category")))
    return f.select("fdc_id", cat.alias("category"))


@register("clean_category", f"""SELECT fdc_id, category AS raw_category, {_clean_sql("category")} AS category FROM ({_CAT_INPUT_SQL})""")
def q_clean_category(spark, d):
    c = _cat_input(spark, d)
    return c.select("fdc_id", F.col("category").alias("raw_category"),
                    m.clean_category(F.col("category")).alias("category"))


_VEG_INPUT_SQL = f"""SELECT fdc_id, CASE WHEN fdc_id % 5 = 0 THEN 'Beef Products'
  WHEN fdc_id % 5 = 1 THEN 'Lamb, Veal, and Game Products' WHEN fdc_id % 5 = 2 THEN food_category || ' SEAFOOD'
  WHEN fdc_id % 5 = 3 THEN NULL ELSE food_category END AS category FROM ({an.RAW_FOOD_SQL})"""


def _veg_input(spark, d):
    f = an.raw_food(spark, d)
    k = F.col("fdc_id") % 5
    cat = (F.when(k == 0, F.lit("Beef Products"))
           .when(k == 1, F.lit("Lamb, Veal, and Game Products"))
           .when(k == 2, F.concat(F.col("food_category"), F.lit(" SEAFOOD")))
           .when(k == 3, F.lit(None).cast("string"))
           .otherwise(F.col("food_category")))
    return f.select("fdc_id", cat.alias("category"))


@register("diet_flag_vegetarian", f"""SELECT fdc_id, category, {_veg_sql("category")} AS vegetarian_friendly FROM ({_VEG_INPUT_SQL})""")
def q_diet_flag_vegetarian(spark, d):
    v = _veg_input(spark, d)
    return v.withColumn("vegetarian_friendly", m.vegetarian_friendly(F.col("category")))


@register("diet_flags_numeric", f"""SELECT fdc_id, {_FLAGS_SQL} FROM ({an.INT_MACRONUTRIENTS_SQL})""")
def q_diet_flags_numeric(spark, d):
    return m.diet_flags(an.macros(spark, d)).select("fdc_id", "low_sodium", "high_protein",
                                                    "low_carb", "low_fat")


@register("calorie_density_band", f"""SELECT *, {_band_sql("calories")} AS calorie_density
  FROM (SELECT fdc_id, calories * 10 AS calories FROM ({an.INT_MACRONUTRIENTS_SQL}))""")
def q_calorie_density_band(spark, d):
    # calories scaled by 10 so the analogue spans every band, 200 and 400 included
    c = an.macros(spark, d).select("fdc_id", (F.col("calories") * 10).alias("calories"))
    return c.withColumn("calorie_density", m.calorie_density_band(F.col("calories")))


@register("require_complete_macros", f"""FROM ({an.INT_MACRONUTRIENTS_SQL}) WHERE {_COMPLETE_SQL}""")
def q_require_complete_macros(spark, d):
    return m.require_complete_macros(an.macros(spark, d))


@register("dedupe_food_names", f"""SELECT fdc_id, food_name, fiber, sodium FROM ({an.INT_MACRONUTRIENTS_SQL}) QUALIFY {_BEST_SQL}""")
def q_dedupe_food_names(spark, d):
    return m.dedupe_food_names(an.macros(spark, d)).select("fdc_id", "food_name", "fiber", "sodium")


@register("data_type_counts", f"""SELECT DISTINCT data_type, CAST(COUNT(*) AS BIGINT) AS count
  FROM ({an.RAW_FOOD_SQL}) GROUP BY data_type""")
def q_data_type_counts(spark, d):
    return m.data_type_counts(an.raw_food(spark, d))


_NULLDESC_SQL = f"""SELECT fdc_id, CASE WHEN fdc_id % 9 = 0 THEN NULL ELSE description END AS description
  FROM ({an.RAW_FOOD_SQL})"""


@register("null_description_counts", f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_rows,
  CAST(COUNT(description) AS BIGINT) AS rows_with_description,
  CAST(COUNT(*) - COUNT(description) AS BIGINT) AS null_descriptions FROM ({_NULLDESC_SQL})""")
def q_null_description_counts(spark, d):
    f = an.raw_food(spark, d)
    f = f.withColumn("description", F.when(F.col("fdc_id") % 9 == 0, F.lit(None))
                     .otherwise(F.col("description")))
    return m.null_description_counts(f)
