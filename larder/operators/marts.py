"""Marts: category statistics (A2) and the meal-planning mart (P5-P9, W1),
plus the raw-table profile queries (A3, A4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Category words excluded by the vegetarian flag (ILIKE '%w%').
NON_VEG_WORDS = ["beef", "pork", "poultry", "fish", "meat", "chicken", "turkey",
                 "lamb", "seafood"]
# Category names excluded by exact match.
NON_VEG_CATEGORIES = ["Poultry Products", "Pork Products", "Beef Products",
                      "Finfish and Shellfish Products", "Lamb, Veal, and Game Products",
                      "Sausages and Luncheon Meats"]


def mart_food_categories(macros: DataFrame, distinct_exact: bool = True) -> DataFrame:
    """A2: per category distinct foods, rounded averages, conditional counts.

    ``count(DISTINCT fdc_id)`` runs as Spark's two-level distinct aggregate
    (expand + partial aggregation), so a large category is reduced map-side.
    ``distinct_exact=False`` swaps in HyperLogLog for very large catalogs.
    """
    distinct = (F.countDistinct("fdc_id") if distinct_exact
                else F.approx_count_distinct("fdc_id"))
    return (macros.where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(distinct.cast("long").alias("total_foods"),
                 F.round(F.avg("calories"), 1).alias("avg_calories"),
                 F.round(F.avg("protein"), 1).alias("avg_protein"),
                 F.round(F.avg("total_fat"), 1).alias("avg_fat"),
                 F.round(F.avg("carbohydrate"), 1).alias("avg_carbs"),
                 F.round(F.avg("fiber"), 1).alias("avg_fiber"),
                 F.count(F.when(F.col("protein") >= 15, 1)).cast("long").alias("high_protein_foods"),
                 F.count(F.when(F.col("sodium") < 140, 1)).cast("long").alias("low_sodium_foods")))


def clean_category(c: Column) -> Column:
    """P5: digits-only, NULL or '' -> 'Uncategorized' (full-string match, K7)."""
    return (F.when(c.rlike(r"\A[0-9]+\z"), F.lit("Uncategorized"))
            .when(c.isNull(), F.lit("Uncategorized"))
            .when(c == F.lit(""), F.lit("Uncategorized"))
            .otherwise(c))


def vegetarian_friendly(category: Column) -> Column:
    """No excluded word (case-insensitive substring) and no excluded name.

    As in SQL, a NULL category makes the NOT IN test unknown, so the CASE
    yields FALSE for it.
    """
    filled = F.coalesce(category, F.lit(""))
    cond = None
    for w in NON_VEG_WORDS:
        term = ~filled.ilike(f"%{w}%")
        cond = term if cond is None else cond & term
    cond = cond & ~category.isin(*NON_VEG_CATEGORIES)
    return F.when(cond, F.lit(True)).otherwise(F.lit(False))


def diet_flags(df: DataFrame) -> DataFrame:
    """Numeric diet flags; NULL comparisons give FALSE."""
    def flag(cond: Column) -> Column:
        return F.when(cond, F.lit(True)).otherwise(F.lit(False))
    return (df.withColumn("low_sodium", flag(F.col("sodium") < 140))
            .withColumn("high_protein", flag(F.col("protein") >= 15))
            .withColumn("low_carb", flag(F.col("carbohydrate") <= 25))
            .withColumn("low_fat", flag(F.col("total_fat") < 5)))


def calorie_density_band(calories: Column) -> Column:
    """First matching band wins, so 200 is 'Low' and 400 'Moderate'."""
    return (F.when(calories < 100, F.lit("Very Low"))
            .when(calories.between(100, 200), F.lit("Low"))
            .when(calories.between(200, 400), F.lit("Moderate"))
            .when(calories > 400, F.lit("High")))


def require_complete_macros(macros: DataFrame) -> DataFrame:
    """Id, calories, protein and name present."""
    return macros.dropna(subset=["fdc_id", "calories", "protein", "food_name"])


def completeness_class(fiber: Column, sodium: Column) -> Column:
    return (F.when(fiber.isNotNull() & sodium.isNotNull(), F.lit(1))
            .when(fiber.isNotNull() | sodium.isNotNull(), F.lit(2))
            .otherwise(F.lit(3)))


def dedupe_food_names(base: DataFrame) -> DataFrame:
    """One row per food name, most complete first, then highest fdc_id.

    ``row_number() = 1`` is planned as a WindowGroupLimit, which keeps only
    the best row per name in each map task before the shuffle, so a name
    shared by millions of foods costs one row per task, not one task.
    """
    w = Window.partitionBy("food_name").orderBy(
        completeness_class(F.col("fiber"), F.col("sodium")).asc(), F.col("fdc_id").desc())
    return (base.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") == 1).drop("rn"))


def mart_meal_planning(macros: DataFrame) -> DataFrame:
    """Meal-planning mart: P9 -> P5 -> W1 -> P6-P8."""
    base = (require_complete_macros(macros)
            .select("fdc_id", F.lower(F.trim("food_name")).alias("food_name"),
                    clean_category(F.col("category")).alias("category"), "data_type",
                    "calories", "protein", "total_fat", "carbohydrate", "fiber", "sodium"))
    d = dedupe_food_names(base)
    d = d.withColumn("vegetarian_friendly", vegetarian_friendly(F.col("category")))
    d = diet_flags(d)
    return d.withColumn("calorie_density", calorie_density_band(F.col("calories")))


def data_type_counts(raw_food: DataFrame) -> DataFrame:
    """A3: rows per data_type (the DISTINCT in the source is redundant)."""
    return raw_food.groupBy("data_type").agg(F.count(F.lit(1)).cast("long").alias("count"))


def null_description_counts(raw_food: DataFrame) -> DataFrame:
    """A4: total rows, rows with a description, and the difference."""
    return raw_food.agg(F.count(F.lit(1)).cast("long").alias("total_rows"),
                        F.count("description").cast("long").alias("rows_with_description"),
                        (F.count(F.lit(1)) - F.count("description")).cast("long").alias("null_descriptions"))
