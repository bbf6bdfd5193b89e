"""Staging views (P1-P4) and the two joined intermediate views.

Each function takes raw DataFrames with the raw-table column names and
returns a lazy DataFrame; nothing is materialized here, so Catalyst sees the
whole raw -> mart plan and pushes filters and column pruning into the scans.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stg_food(raw_food: DataFrame) -> DataFrame:
    """lower(trim(description)); the emptiness test is on the raw value."""
    return (raw_food
            .where(F.col("description").isNotNull()
                   & (F.col("description") != F.lit(""))
                   & F.col("fdc_id").isNotNull())
            .select("fdc_id", "data_type",
                    F.lower(F.trim("description")).alias("food_name"),
                    F.col("food_category").alias("category")))


def stg_food_nutrient(raw_food_nutrient: DataFrame,
                      loaded_at: _dt.datetime | None = None) -> DataFrame:
    """Both ids present and amount >= 0 (so NULL amounts are dropped too)."""
    loaded = (F.lit(loaded_at).cast("timestamp_ntz") if loaded_at is not None
              else F.lit(None).cast("timestamp_ntz"))
    return (raw_food_nutrient
            .where(F.col("fdc_id").isNotNull() & F.col("nutrient_id").isNotNull()
                   & (F.col("amount") >= 0))
            .select(F.col("id").alias("food_nutrient_id"), "fdc_id", "nutrient_id",
                    F.coalesce(F.col("amount"), F.lit(0.0)).alias("nutrient_amount"),
                    "data_points", "min_value", "max_value", "median_value",
                    "percent_daily_value", loaded.alias("_loaded_at")))


def stg_food_portion(raw_food_portion: DataFrame,
                     loaded_at: _dt.datetime | None = None) -> DataFrame:
    """Keep portions with a positive gram weight."""
    loaded = (F.lit(loaded_at).cast("timestamp_ntz") if loaded_at is not None
              else F.lit(None).cast("timestamp_ntz"))
    return (raw_food_portion
            .where(F.col("fdc_id").isNotNull() & F.col("gram_weight").isNotNull()
                   & (F.col("gram_weight") > 0))
            .select(F.col("id").alias("portion_id"), "fdc_id", "portion_description",
                    "gram_weight", "measure_unit_id", loaded.alias("_loaded_at")))


def stg_nutrient(raw_nutrient: DataFrame) -> DataFrame:
    """Trimmed nutrient names, names present."""
    return (raw_nutrient.where(F.col("name").isNotNull())
            .select(F.col("id").alias("nutrient_id"),
                    F.trim("name").alias("nutrient_name"),
                    "unit_name", "nutrient_nbr", "rank_order"))


def food_nutrition_complete(raw_food: DataFrame, raw_food_nutrient: DataFrame,
                            raw_nutrient: DataFrame) -> DataFrame:
    """Food LEFT JOIN fact LEFT JOIN nutrient; foods without facts stay.

    The left join is an inner join, whose large side adaptive execution may
    split where one food holds very many facts, united with the foods that
    have none. The nutrient dimension is small but its size is only known at
    run time, so its join strategy is left to AQE (a broadcast when the
    runtime size is under the threshold) instead of a blind hint.
    """
    foods = raw_food.where(F.col("description").isNotNull()).select("fdc_id", "description", "food_category")
    facts = raw_food_nutrient.select("fdc_id", "nutrient_id", "amount")
    known = facts.join(foods, "fdc_id").select("fdc_id", "description", "food_category", "nutrient_id", "amount")
    bare = foods.join(facts.select("fdc_id").distinct(), "fdc_id", "left_anti")
    both = known.unionByName(bare, allowMissingColumns=True)
    n = raw_nutrient.select(F.col("id").alias("_id"), F.col("name").alias("nutrient_name"), "unit_name")
    return (both.join(n, F.col("nutrient_id") == F.col("_id"), "left")
            .select("fdc_id", "description", "food_category", "nutrient_id", "nutrient_name", "unit_name", "amount"))


def int_food_nutrition(stg_f: DataFrame, stg_fn: DataFrame, stg_n: DataFrame) -> DataFrame:
    """Staged food x fact x nutrient with a non-null amount.

    The WHERE on the fact side lets Catalyst turn the first outer join into an
    inner join (EliminateOuterJoin), so foods without facts never shuffle.
    """
    f, fn, n = stg_f.alias("f"), stg_fn.alias("fn"), stg_n.alias("n")
    return (f.join(fn, F.col("f.fdc_id") == F.col("fn.fdc_id"), "left")
            .join(n, F.col("fn.nutrient_id") == F.col("n.nutrient_id"), "left")
            .where(F.col("fn.nutrient_amount").isNotNull())
            .select(F.col("f.fdc_id").alias("fdc_id"), F.col("f.food_name").alias("food_name"),
                    F.col("f.category").alias("category"), F.col("f.data_type").alias("data_type"),
                    F.col("fn.nutrient_id").alias("nutrient_id"),
                    F.col("n.nutrient_name").alias("nutrient_name"),
                    F.col("n.unit_name").alias("unit_name"),
                    F.col("fn.nutrient_amount").alias("amount_per_100g"),
                    F.col("fn.data_points").alias("data_points"),
                    F.col("fn.min_value").alias("min_value"),
                    F.col("fn.max_value").alias("max_value")))


# The six LIKE patterns of the macronutrient pivot, in order,
# with the output column each one fills.
MACRO_PATTERNS = [
    ("calories", "%Energy%"),
    ("protein", "%Protein%"),
    ("total_fat", "%Total lipid%"),
    ("carbohydrate", "%Carbohydrate%"),
    ("fiber", "%Fiber%"),
    ("sodium", "%Sodium%"),
]


def int_macronutrients(stg_f: DataFrame, stg_fn: DataFrame, stg_n: DataFrame,
                       energy_unit: str | None = None,
                       broadcast_nutrients: bool = True) -> DataFrame:
    """A1: conditional-max pivot of six nutrients per food (amount > 0 only).

    Plan shape (the one that survives a hot food id holding a third of the
    facts): facts join the nutrient dimension map-side (broadcast; the
    dimension is a code table of a few hundred rows), are reduced to one row
    per food with a partial + final aggregate, and only then meet the food
    table. The last GROUP BY over (fdc_id, name, category, type) reuses the
    hash partitioning on fdc_id from the join, so it adds no shuffle.
    ``energy_unit`` optionally restricts the Energy match to one unit (K1).
    """
    n = stg_n.select("nutrient_id", "nutrient_name", "unit_name")
    if broadcast_nutrients:
        # the dimension is a code table; broadcast it only after a bounded
        # size check, else leave the join to sort-merge / AQE
        from larder.operators.common import broadcast_if_small
        n = broadcast_if_small(n, 1_000_000)
    facts = (stg_fn.where(F.col("nutrient_amount") > 0)
             .select("fdc_id", "nutrient_id", "nutrient_amount")
             .join(n, "nutrient_id", "left"))
    per_food = []
    for out, pattern in MACRO_PATTERNS:
        cond = F.col("nutrient_name").like(pattern)
        if out == "calories" and energy_unit is not None:
            cond = cond & (F.upper(F.col("unit_name")) == F.lit(energy_unit.upper()))
        per_food.append(F.max(F.when(cond, F.col("nutrient_amount"))).alias(out))
    macros = facts.groupBy("fdc_id").agg(*per_food)
    outs = [c for c, _ in MACRO_PATTERNS]
    return (stg_f.join(macros, "fdc_id", "inner")
            .groupBy("fdc_id", "food_name", "category", "data_type")
            .agg(*[F.max(c).alias(c) for c in outs]))
