"""Plan documents: validation, day-name repair, flattening into the four
plan tables, suggestions, shopping rows, week summary, utilization and the
meal-update merge (D7-D9, D30, D31, D35, A8, A9, S15).

A document is parsed once with an explicit schema; nested arrays and maps
are exploded with generators, so every table is a projection of one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import schemas as sc
from larder.functions.mathfn import pyround
from larder.operators.common import once

REQUIRED_KEYS = ["user_summary", "meal_plan", "recommendations", "metadata"]
MEAL_ORDER = ["breakfast", "lunch", "dinner", "snacks"]


def parse_plan(docs: DataFrame, col: str = "document", schema: T.StructType = sc.PLAN_DOCUMENT) -> DataFrame:
    """The document as ``doc``, parsed once a row whatever is selected or
    filtered after it; ``schema`` may name only the fields that are used
    (``schemas.only``)."""
    return docs.withColumn("doc", once(F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})))


def validate_plan(docs: DataFrame, col: str = "document") -> DataFrame:
    """The four required keys and at least one day; with a reason. A text
    is parsed once; the checks read the parsed value. A value got as a variant
    is copied, so the large one is only asked for where it has no days."""
    def why(v):
        # days as numbers: they are only counted (what is no number is a NULL)
        days = F.try_variant_get(v, "$.meal_plan.days", "array<int>")

        def has(key):
            found = F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
            return days.isNotNull() | found if key == "meal_plan" else found
        reason = F.lit(None).cast("string")
        for k in reversed(REQUIRED_KEYS):
            reason = F.when(~has(k), F.lit(f"missing {k}")).otherwise(reason)
        return (F.when(v.isNull(), F.lit("not json")).otherwise(
            F.coalesce(reason, F.when(days.isNull(), F.lit("missing days"))
                       .when(F.size(days) < 1, F.lit("no days")))))
    rest = [c for c in docs.columns if c not in ("is_valid", "reason")]
    checked = docs.select(*rest, F.explode(F.transform(F.array(F.try_parse_json(F.col(col))), why)).alias("reason"))
    return checked.select(*rest, F.col("reason").isNull().alias("is_valid"), "reason")


def fix_day_names(parsed: DataFrame, start_col: str = "start_date") -> DataFrame:
    """Position i -> day i+1 and the weekday name of start + i."""
    d = parsed.select("*", F.posexplode("doc.meal_plan.days").alias("pos", "d"))
    return d.select("*", (F.col("pos") + 1).alias("fixed_day"),
                    F.date_format(F.date_add(F.col(start_col), F.col("pos")), "EEEE").alias("fixed_day_name"))


def flatten_plan(parsed: DataFrame, key_cols: list[str], start_col: str = "start_date") -> dict[str, DataFrame]:
    """One document -> plan row, day rows, meal rows (fixed type order,
    defaults applied) and one shopping row when the summary is non-empty."""
    start = F.col(start_col)
    plans = parsed.select(*key_cols, start.alias("start_date"), F.date_add(start, 6).alias("end_date"),
                          F.concat(F.lit("Week of "), F.date_format(start, "MMMM dd, yyyy")).alias("plan_name"),
                          F.to_json(F.col("doc.meal_plan.week_summary")).alias("week_summary"),
                          F.lit("ACTIVE").alias("status"))
    days = parsed.select(*key_cols, start.alias("start_date"), F.posexplode("doc.meal_plan.days").alias("pos", "d"))
    day_no = F.coalesce(F.col("d.day"), F.lit(0))
    day_rows = days.select(*key_cols, "pos", day_no.alias("day_number"),
                           F.coalesce(F.col("d.day_name"), F.lit("")).alias("day_name"),
                           F.date_add(F.col("start_date"), F.coalesce(F.col("d.day"), F.lit(1)) - 1).alias("meal_date"),
                           F.col("d.total_nutrition").alias("total_nutrition"), F.col("d.meals").alias("meals"))
    typed = F.array(*[F.struct(F.lit(i).alias("type_pos"), F.lit(t).alias("meal_type"),
                               F.element_at(F.col("meals"), F.lit(t)).alias("m"))
                      for i, t in enumerate(MEAL_ORDER)])
    meals = (day_rows.select(*key_cols, "pos", "day_number", "meal_date", F.explode(typed).alias("x"))
             .where(F.col("x.m").isNotNull())
             .select(*key_cols, "pos", "day_number", "meal_date", F.col("x.type_pos").alias("type_pos"),
                     F.col("x.meal_type").alias("meal_type"),
                     F.coalesce(F.col("x.m.meal_name"), F.lit("Unknown Meal")).alias("meal_name"),
                     F.coalesce(F.col("x.m.preparation_time"), F.lit(0)).alias("preparation_time"),
                     F.coalesce(F.col("x.m.cooking_time"), F.lit(0)).alias("cooking_time"),
                     F.coalesce(F.col("x.m.servings"), F.lit(1)).alias("servings"),
                     F.coalesce(F.col("x.m.serving_size"), F.lit("1 serving")).alias("serving_size"),
                     F.coalesce(F.col("x.m.recipe.difficulty_level"), F.lit("medium")).alias("difficulty_level"),
                     F.col("x.m.nutrition.calories").alias("calories")))
    shop = F.col("doc.recommendations.shopping_list_summary")
    non_empty = shop.isNotNull() & (F.to_json(shop) != F.lit("{}"))
    lists = parsed.where(non_empty).select(
        *key_cols, F.coalesce(shop["total_estimated_cost"], F.lit(0.0)).alias("total_estimated_cost"),
        F.coalesce(shop["total_items_from_inventory"], F.lit(0)).alias("total_items_from_inventory"),
        F.coalesce(shop["total_items_to_purchase"], F.lit(0)).alias("total_items_to_purchase"))
    return {"meal_plans": plans, "daily_meals": day_rows.drop("meals"), "meal_details": meals,
            "shopping_lists": lists}


def plan_rows(parsed: DataFrame, key_cols: list[str], start_col: str = "start_date") -> DataFrame:
    """The rows of all four plan tables in one pass over the documents:
    ``table`` and a struct column per table, of which that one is set.

    A document is exploded once into its plan (position 0) and its days, and
    each of these into its rows.
    """
    plan, start = F.lit(None).cast(sc.DAY), F.col(start_col)
    days = F.concat(F.array(plan), F.coalesce("doc.meal_plan.days", F.array().cast(T.ArrayType(sc.DAY))))
    units = parsed.select(*key_cols, start.alias("start_date"), "doc.meal_plan.week_summary", "doc.recommendations.shopping_list_summary",
                          F.posexplode(days).alias("pos", "d"))
    keys, at, shop = [F.col(k) for k in key_cols], F.col("pos") - 1, F.col("shopping_list_summary")
    day = F.struct(*keys, at.alias("pos"), F.coalesce("d.day", F.lit(0)).alias("day_number"), F.coalesce("d.day_name", F.lit("")).alias("day_name"),
                   F.date_add("start_date", F.coalesce("d.day", F.lit(1)) - 1).alias("meal_date"), F.col("d.total_nutrition").alias("total_nutrition"))
    meals = []
    for i, name in enumerate(MEAL_ORDER):
        m = F.element_at("d.meals", F.lit(name))
        meals.append((m.isNotNull(), F.struct(
            *keys, at.alias("pos"), day["day_number"].alias("day_number"), day["meal_date"].alias("meal_date"), F.lit(i).alias("type_pos"), F.lit(name).alias("meal_type"),
            F.coalesce(m["meal_name"], F.lit("Unknown Meal")).alias("meal_name"), F.coalesce(m["preparation_time"], F.lit(0)).alias("preparation_time"),
            F.coalesce(m["cooking_time"], F.lit(0)).alias("cooking_time"), F.coalesce(m["servings"], F.lit(1)).alias("servings"),
            F.coalesce(m["serving_size"], F.lit("1 serving")).alias("serving_size"),
            F.coalesce(m["recipe"]["difficulty_level"], F.lit("medium")).alias("difficulty_level"), m["nutrition"]["calories"].alias("calories"))))
    plan = F.struct(*keys, F.col("start_date"), F.date_add("start_date", 6).alias("end_date"), F.concat(F.lit("Week of "), F.date_format("start_date", "MMMM dd, yyyy")).alias("plan_name"),
                    F.to_json("week_summary").alias("week_summary"), F.lit("ACTIVE").alias("status"))
    bought = F.struct(*keys, F.coalesce(shop["total_estimated_cost"], F.lit(0.0)).alias("total_estimated_cost"),
                      F.coalesce(shop["total_items_from_inventory"], F.lit(0)).alias("total_items_from_inventory"),
                      F.coalesce(shop["total_items_to_purchase"], F.lit(0)).alias("total_items_to_purchase"))
    first = F.col("pos") == 0
    some = [("meal_plans", first, plan), ("shopping_lists", first & shop.isNotNull() & (F.to_json(shop) != "{}"), bought),
            ("daily_meals", ~first, day), *[("meal_details", ~first & there, meal) for there, meal in meals]]
    tables = ["meal_plans", "daily_meals", "meal_details", "shopping_lists"]

    def row(table, there, value):
        return F.when(there, F.struct(F.lit(table).alias("table"), *[(value if t == table else F.lit(None)).alias(t) for t in tables]))
    # typed alike, so that they can stand in one array
    shapes = units.select(*[next(v for t, _, v in some if t == n).alias(n) for n in tables]).schema
    rows = F.array_compact(F.array(*[row(t, there, v).cast(T.StructType([T.StructField("table", T.StringType()), *[T.StructField(f.name, f.dataType) for f in shapes]]))
                                     for t, there, v in some]))
    return units.select(F.explode(rows).alias("r")).select("r.*")


def plan_suggestions(parsed: DataFrame, key_cols: list[str]) -> DataFrame:
    """Suggestions -> rows with display defaults."""
    s = parsed.select(*key_cols, F.posexplode("doc.future_suggestions").alias("pos", "s"))
    return s.select(*key_cols, "pos", F.coalesce("s.item", F.lit("Unknown")).alias("item"),
                    F.coalesce("s.reason", F.lit("")).alias("reason"),
                    F.coalesce("s.category", F.lit("General")).alias("category"),
                    F.coalesce("s.suggested_quantity", F.lit(1.0)).alias("suggested_quantity"),
                    F.coalesce("s.unit", F.lit("unit")).alias("unit"))


def replaced_suggestions(parsed: DataFrame, suggestions: DataFrame, key_cols: list[str]) -> DataFrame:
    """The new ``suggestions`` (key columns, items) take the place of
    ``future_suggestions`` inside the week summary of their plan; all else in
    the summary stays. Plans without a summary or without new suggestions are
    not updated and have no row. Returns the key columns and the summary as
    JSON text."""
    summary = F.col("doc.meal_plan.week_summary")
    j = parsed.where(summary.isNotNull()).select(*key_cols, summary.alias("_s")).join(suggestions, key_cols)
    return j.select(*key_cols, F.to_json(F.col("_s").withField("future_suggestions", F.col("items"))).alias("week_summary"))


def shopping_list_items(parsed: DataFrame, key_cols: list[str]) -> DataFrame:
    """Every category array of the summary -> (category, item, qty, unit)."""
    shop = F.col("doc.recommendations.shopping_list_summary")
    cats = F.array(*[F.struct(F.lit(k).alias("category"), shop[k].alias("items")) for k in sc.SHOPPING_KEYS])
    c = parsed.select(*key_cols, F.explode(cats).alias("c"))
    i = c.select(*key_cols, "c.category", F.posexplode_outer("c.items").alias("pos", "it")).where(F.col("it").isNotNull())
    return i.select(*key_cols, "category", "pos", F.col("it.item").alias("item"),
                    F.col("it.quantity_to_purchase").alias("quantity_to_purchase"), F.col("it.unit").alias("unit"))


def week_summary(parsed: DataFrame, key_cols: list[str]) -> DataFrame:
    """Averages over the days: calories truncated, others rounded to 1
    (a missing day nutrition counts as 0). Sums fold over the days array in
    document order, as the reference does, so the float result does not
    depend on task order; it is a per-document projection (no shuffle)."""
    days = F.col("doc.meal_plan.days")
    n = F.size(days)

    def tot(f):
        return F.aggregate(days, F.lit(0.0), lambda a, d: a + F.coalesce(d["total_nutrition"][f], F.lit(0.0)))
    return parsed.where(n > 0).select(
        *key_cols, (tot("calories") / n).cast("int").alias("average_daily_calories"),
        pyround(tot("protein_g") / n, 1).alias("average_daily_protein"),
        pyround(tot("carbohydrates_g") / n, 1).alias("average_daily_carbs"),
        pyround(tot("fat_g") / n, 1).alias("average_daily_fat"),
        pyround(tot("fiber_g") / n, 1).alias("average_daily_fiber"),
        n.cast("long").alias("num_days"))


def inventory_utilization(items_used: Column, inventory_count: Column) -> Column:
    """round(min(used / items * 100, 100), 1); 0 without inventory."""
    rate = F.least(F.try_divide(items_used * 100.0, inventory_count), F.lit(100.0))
    return F.when(inventory_count > 0, pyround(rate, 1)).otherwise(F.lit(0.0))


def merge_meal_update(details: DataFrame, updates: DataFrame, key: str = "detail_id",
                      cols: tuple[str, ...] = ("meal_name", "calories")) -> tuple[DataFrame, DataFrame]:
    """Apply updated meal rows by id (NULL keeps the old value); returns
    (merged rows, update ids without a match). One left join + one anti join."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols])
    merged = details.join(u, key, "left")
    for c in cols:
        merged = merged.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c))).drop(f"_u_{c}")
    misses = updates.join(details.select(key), key, "left_anti")
    return merged, misses
