"""Explicit schemas for the semi-structured plan documents."""

from __future__ import annotations

from pyspark.sql import types as T

from larder.functions.jsonfn import INGREDIENTS, NUTRITION

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

RECIPE = T.StructType([
    T.StructField("equipment_needed", T.ArrayType(S)), T.StructField("prep_steps", T.ArrayType(S)),
    T.StructField("cooking_instructions", T.ArrayType(S)), T.StructField("tips", T.ArrayType(S)),
    T.StructField("difficulty_level", S)])
INVENTORY_IMPACT = T.StructType([T.StructField("items_used", I), T.StructField("new_purchases_needed", I)])
MEAL = T.StructType([
    T.StructField("meal_name", S), T.StructField("ingredients_with_quantities", INGREDIENTS),
    T.StructField("recipe", RECIPE), T.StructField("nutrition", NUTRITION),
    T.StructField("preparation_time", I), T.StructField("cooking_time", I),
    T.StructField("servings", I), T.StructField("serving_size", S)])
DAY = T.StructType([
    T.StructField("day", I), T.StructField("day_name", S), T.StructField("total_nutrition", NUTRITION),
    T.StructField("inventory_impact", INVENTORY_IMPACT), T.StructField("meals", T.MapType(S, MEAL))])
SUGGESTION = T.StructType([
    T.StructField("item", S), T.StructField("reason", S), T.StructField("category", S),
    T.StructField("suggested_quantity", D), T.StructField("unit", S)])
WEEK_SUMMARY = T.StructType([
    T.StructField("average_daily_calories", I), T.StructField("average_daily_protein", D),
    T.StructField("average_daily_carbs", D), T.StructField("average_daily_fat", D),
    T.StructField("average_daily_fiber", D), T.StructField("inventory_utilization_rate", D),
    T.StructField("future_suggestions", T.ArrayType(SUGGESTION))])
SHOP_ITEM = T.StructType([
    T.StructField("item", S), T.StructField("quantity_to_purchase", S),
    T.StructField("total_quantity_needed", S), T.StructField("unit", S)])
# Shopping categories written by the generator, plus the
# key the list page reads.
SHOPPING_KEYS = ["proteins", "produce", "pantry", "grains", "vegetables", "fruits", "dairy_alternatives",
                 "pantry_items"]
SHOPPING = T.StructType([T.StructField(k, T.ArrayType(SHOP_ITEM)) for k in SHOPPING_KEYS] + [
    T.StructField("total_estimated_cost", D), T.StructField("total_items_from_inventory", I),
    T.StructField("total_items_to_purchase", I)])
PLAN_DOCUMENT = T.StructType([
    T.StructField("user_summary", T.MapType(S, S)),
    T.StructField("meal_plan", T.StructType([T.StructField("week_summary", WEEK_SUMMARY),
                                             T.StructField("days", T.ArrayType(DAY))])),
    T.StructField("recommendations", T.StructType([T.StructField("shopping_list_summary", SHOPPING)])),
    T.StructField("metadata", T.MapType(S, S)),
    T.StructField("future_suggestions", T.ArrayType(SUGGESTION))])


def only(schema: T.DataType, paths: list[str]) -> T.DataType:
    """``schema`` with the fields on the dotted ``paths`` (each with all below
    it); elements of arrays and values of maps have no name of their own. Text
    that is parsed with it is read as a whole; fewer values are kept of it."""
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(only(schema.elementType, paths), schema.containsNull)
    if isinstance(schema, T.MapType):
        return T.MapType(schema.keyType, only(schema.valueType, paths), schema.valueContainsNull)
    below: dict[str, list[str]] = {}
    for p in paths:
        name, _, rest = p.partition(".")
        below.setdefault(name, []).append(rest)
    missing = set(below) - set(schema.names)
    if missing:
        raise KeyError(f"no field {sorted(missing)}")
    return T.StructType([f if "" in below[f.name] else T.StructField(f.name, only(f.dataType, below[f.name]), f.nullable)
                         for f in schema.fields if f.name in below])
