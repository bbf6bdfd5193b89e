"""Pantry operators: unit standardization (D5, J15), inventory grouping
(A26, A30, P17), model-reply normalization (D24), shopping-list merge (J14,
D6) and serving totals (J17, D16). All are column expressions, literal code
tables, joins and aggregates; no row-level Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.mathfn import pyround

# Unit text -> (multiplier, standard unit), weights to grams.
WEIGHT_UNITS = [
    ("g", 1.0, "gm"), ("gm", 1.0, "gm"), ("gram", 1.0, "gm"), ("grams", 1.0, "gm"),
    ("kg", 1000.0, "gm"), ("kilogram", 1000.0, "gm"), ("kilograms", 1000.0, "gm"),
    ("oz", 28.35, "gm"), ("ounce", 28.35, "gm"), ("ounces", 28.35, "gm"),
    ("lb", 453.592, "gm"), ("lbs", 453.592, "gm"), ("pound", 453.592, "gm"), ("pounds", 453.592, "gm"),
]
# Unit text -> (multiplier, standard unit), volumes to ml.
VOLUME_UNITS = [
    ("ml", 1.0, "ml"), ("milliliter", 1.0, "ml"), ("milliliters", 1.0, "ml"),
    ("l", 1000.0, "ml"), ("liter", 1000.0, "ml"), ("liters", 1000.0, "ml"),
    ("litre", 1000.0, "ml"), ("litres", 1000.0, "ml"),
    ("fl oz", 29.5735, "ml"), ("fluid ounce", 29.5735, "ml"),
    ("cup", 236.588, "ml"), ("cups", 236.588, "ml"), ("pint", 473.176, "ml"), ("pints", 473.176, "ml"),
    ("gallon", 3785.41, "ml"), ("gallons", 3785.41, "ml"),
    ("tbsp", 14.787, "ml"), ("tablespoon", 14.787, "ml"), ("tablespoons", 14.787, "ml"),
    ("tsp", 4.929, "ml"), ("teaspoon", 4.929, "ml"), ("teaspoons", 4.929, "ml"),
]
# Container words, their default ml (checked in this order),
# count words that disable the container rule, liquid item words.
LIQUID_CONTAINERS = ["carton", "bottle", "can", "glass", "cup", "jug", "pitcher"]
CONTAINER_DEFAULT_ML = [("carton", 946.0), ("bottle", 500.0), ("can", 355.0), ("glass", 240.0)]
COUNT_WORDS = ["pieces", "items", "box", "bunch"]
LIQUID_KEYWORDS = ["milk", "juice", "kombucha", "water", "beverage", "drink", "oil", "sauce",
                   "syrup", "yogurt", "cream", "almond"]
LIQUID_ITEM_ML = 500.0
# Categories accepted from an inventory extraction.
VALID_INVENTORY_CATEGORIES = ["Produce", "Dairy & Eggs", "Meat & Seafood", "Pantry", "Frozen",
                              "Beverages", "Snacks", "Spices & Seasonings", "Other"]
# Shopping-list categories merged across two batches.
SHOPPING_CATEGORIES = ["proteins", "produce", "pantry", "grains", "vegetables", "fruits",
                       "dairy_alternatives"]


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def _unit_map(rows) -> Column:
    kv = []
    for name, mult, std in rows:
        kv += [F.lit(name), F.struct(F.lit(mult).alias("m"), F.lit(std).alias("u"))]
    return F.create_map(*kv)


def unit_factor(unit: Column, item_name: Column) -> Column:
    """D5 rules 1-5 as struct(factor, std_unit, rounded): the multiplier
    each rule applies (rule 5 keeps the quantity: factor 1, not rounded)."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    item = F.lower(F.coalesce(item_name, F.lit("")))
    is_container = _any_contains(u, LIQUID_CONTAINERS)
    is_liquid = _any_contains(item, LIQUID_KEYWORDS)
    container_ok = is_container & ~_any_contains(u, COUNT_WORDS)
    default_ml = None
    for word, ml in CONTAINER_DEFAULT_ML:
        cond = F.contains(u, F.lit(word))
        default_ml = F.when(cond, F.lit(ml)) if default_ml is None else default_ml.when(cond, F.lit(ml))
    w = F.element_at(_unit_map(WEIGHT_UNITS), u)
    v = F.element_at(_unit_map(VOLUME_UNITS), u)

    def out(f, unit_name, rounded=True):
        return F.struct(f.cast("double").alias("factor"),
                        (F.lit(unit_name) if isinstance(unit_name, str) else unit_name).alias("std_unit"),
                        F.lit(rounded).alias("rounded"))
    return (F.when(container_ok & default_ml.isNotNull(), out(default_ml, "ml"))
            .when(is_liquid & is_container, out(F.lit(LIQUID_ITEM_ML), "ml"))
            .when(w.isNotNull(), out(w["m"], w["u"]))
            .when(v.isNotNull(), out(v["m"], v["u"]))
            .otherwise(out(F.lit(1.0), "pieces", False)))


def standardize_unit(quantity: Column, unit: Column, item_name: Column) -> Column:
    """struct(std_quantity, std_unit) following the five ordered rules:
    container default ml, liquid item in a container (500 ml), weight table,
    volume table, else pieces (quantity unrounded). Rules 1-4 round to 2.
    For large inputs prefer :func:`with_standard_unit`, which evaluates the
    rule chain once per row."""
    f = unit_factor(unit, item_name)
    q = quantity * f["factor"]
    return F.struct(F.when(f["rounded"], pyround(q, 2)).otherwise(quantity).cast("double").alias("std_quantity"),
                    f["std_unit"].alias("std_unit"))


def with_standard_unit(df: DataFrame, quantity: str, unit: str, item: str, out: str = "std") -> DataFrame:
    """D5 staged for large inputs: normalized unit/item text, then the
    container flags and table lookups, then the chosen factor, then the
    rounded product. Each stage reads plain columns of the previous one, so
    no text function or map lookup is evaluated more than once per row."""
    x = (df.withColumn("_u", F.lower(F.trim(F.coalesce(F.col(unit), F.lit("")))))
         .withColumn("_i", F.lower(F.coalesce(F.col(item), F.lit("")))))
    dml = None
    for word, ml in CONTAINER_DEFAULT_ML:
        cond = F.contains(F.col("_u"), F.lit(word))
        dml = F.when(cond, F.lit(ml)) if dml is None else dml.when(cond, F.lit(ml))
    x = x.select("*", _any_contains(F.col("_u"), LIQUID_CONTAINERS).alias("_cont"),
                 _any_contains(F.col("_u"), COUNT_WORDS).alias("_cnt"),
                 _any_contains(F.col("_i"), LIQUID_KEYWORDS).alias("_liq"), dml.alias("_dml"),
                 F.element_at(_unit_map(WEIGHT_UNITS), F.col("_u")).alias("_w"),
                 F.element_at(_unit_map(VOLUME_UNITS), F.col("_u")).alias("_v"))
    factor = (F.when(F.col("_cont") & ~F.col("_cnt") & F.col("_dml").isNotNull(), F.struct(F.col("_dml").alias("f"), F.lit("ml").alias("u")))
              .when(F.col("_liq") & F.col("_cont"), F.struct(F.lit(LIQUID_ITEM_ML).alias("f"), F.lit("ml").alias("u")))
              .when(F.col("_w").isNotNull(), F.struct(F.col("_w.m").alias("f"), F.col("_w.u").alias("u")))
              .when(F.col("_v").isNotNull(), F.struct(F.col("_v.m").alias("f"), F.col("_v.u").alias("u"))))
    x = x.withColumn("_f", factor).withColumn("_q", F.col(quantity) * F.col("_f.f"))
    return (x.withColumn(out, F.struct(F.when(F.col("_f").isNotNull(), pyround(F.col("_q"), 2)).otherwise(F.col(quantity))
                                       .cast("double").alias("std_quantity"),
                                       F.coalesce(F.col("_f.u"), F.lit("pieces")).alias("std_unit")))
            .drop("_u", "_i", "_cont", "_cnt", "_liq", "_dml", "_w", "_v", "_f", "_q"))


def unit_dim(spark: SparkSession) -> DataFrame:
    """Unit dimension (weights then volumes) as a literal table."""
    return spark.createDataFrame(WEIGHT_UNITS + VOLUME_UNITS, "unit_key string, multiplier double, std_unit string")


def unit_dim_join(items: DataFrame, spark: SparkSession) -> DataFrame:
    """Unit text -> (multiplier, target unit); literal dimension of a
    fixed size, so the broadcast is bounded."""
    keyed = items.withColumn("unit_key", F.lower(F.trim("unit")))
    return keyed.join(F.broadcast(unit_dim(spark)), "unit_key", "left")


def in_stock_inventory(inv: DataFrame) -> DataFrame:
    """P17."""
    return inv.where(F.col("quantity") > 0)


def inventory_category(c: Column) -> Column:
    """``category or 'Other'``: NULL and '' both become Other."""
    return F.when(c.isNull() | (c == ""), F.lit("Other")).otherwise(c)


def inventory_by_category(inv: DataFrame) -> DataFrame:
    """The per-user inventory grouped by category, as ranked rows (the
    grouping is kept in rows, so no user's pantry is collected into one
    value); items are ordered by name within the category. The rank comes
    from a range-partitioned global index minus the group's first index, so
    one very large (user, category) group is spread over many tasks."""
    from larder.operators.common import global_index
    x = inv.withColumn("category", inventory_category(F.col("category")))
    idx = global_index(x, ["user_id", "category", "item_name", "inventory_id"], name="_gi")
    start = idx.groupBy("user_id", "category").agg(F.min("_gi").alias("_start"))
    return (idx.join(start, ["user_id", "category"])
            .withColumn("item_rank", (F.col("_gi") - F.col("_start") + 1).cast("int")).drop("_gi", "_start"))


def category_item_counts(inv: DataFrame) -> DataFrame:
    """Items per (user, category) and the user's total."""
    x = inv.withColumn("category", inventory_category(F.col("category")))
    per = x.groupBy("user_id", "category").agg(F.count(F.lit(1)).cast("long").alias("n_items"))
    tot = x.groupBy("user_id").agg(F.count(F.lit(1)).cast("long").alias("total_items"))
    return per.join(tot, "user_id")


# The totals of a shopping list.
SHOPPING_TOTALS = ["total_estimated_cost", "total_items_from_inventory", "total_items_to_purchase"]

INVENTORY_ITEM = T.StructType([
    T.StructField("item_name", T.StringType()), T.StructField("quantity", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("category", T.StringType()),
])


def normalize_inventory(replies: DataFrame, text_col: str = "content") -> DataFrame:
    """A model reply -> inventory rows.

    Code fences are stripped (text between the first two fences, minus a
    leading ``json``), an object becomes a one-element list, categories
    outside the valid list become Other, defaults fill gaps; text that does
    not parse, or has a quantity that is no number, becomes one item named by
    its first 50 characters.
    """
    t = F.col(text_col)
    inner = F.when(F.contains(t, F.lit("```")), F.split(t, "```", 3)[1]).otherwise(t)
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    body = F.regexp_replace(inner, r"^\s+|\s+$", "")
    v = F.try_parse_json(body)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    is_arr = F.schema_of_variant(v).startswith("ARRAY")
    arr_json = F.when(is_obj, F.concat(F.lit("["), body, F.lit("]"))).when(is_arr, body)
    items = F.from_json(arr_json, T.ArrayType(INVENTORY_ITEM))
    qty = lambda x: F.coalesce(x["quantity"].try_cast("double"), F.lit(1.0))
    good = F.transform(items, lambda x: F.struct(
        F.coalesce(x["item_name"], F.lit("Unknown Item")).alias("item"),
        qty(x).alias("quantity"),
        F.coalesce(x["unit"], F.lit("unit")).alias("unit"),
        F.when(x["category"].isin(*VALID_INVENTORY_CATEGORIES), x["category"]).otherwise(F.lit("Other"))
         .alias("category")))
    fallback = F.array(F.struct(F.substring(t, 1, 50).alias("item"), F.lit(1.0).alias("quantity"),
                                F.lit("unit").alias("unit"), F.lit("Other").alias("category")))
    bad = F.exists(items, lambda x: x["quantity"].isNotNull() & x["quantity"].try_cast("double").isNull())
    rows = F.when(items.isNotNull() & ~F.coalesce(bad, F.lit(False)), good).otherwise(fallback)
    keep = [c for c in replies.columns if c != text_col]
    return (replies.select(*keep, F.posexplode(rows).alias("item_pos", "it"))
            .select(*keep, "item_pos", "it.item", "it.quantity", "it.unit", "it.category"))


def shopping_consolidation(b1: DataFrame, b2: DataFrame, key_cols=("plan_id",)) -> DataFrame:
    """Merge two shopping batches per (key, category, lower(item)).

    Inputs: key columns, category, item, quantity_to_purchase and
    total_quantity_needed (text; NULL stands for a missing one and counts as
    0), unit, pos (order inside the batch). The base row of a name is its
    **last** batch-1 row, or else its first batch-2 row. The other batch-2
    rows are added to it one by one: a row whose quantity is no number is
    skipped, and one whose total is no number adds its quantity only (K9).
    Nothing is added to a base whose own value is no number, and a value to
    which nothing is added keeps its text. Units are not compared.

    Plan: both batches are stacked and reduced with one conditional
    aggregate per key (partial aggregation before the shuffle), then the
    batch-1 rows are joined back to it on the same key.
    """
    keys = list(key_cols) + ["category", "item_key"]

    def number(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c).try_cast("double"))

    def prep(b, n):
        return (b.where(F.col("category").isin(*SHOPPING_CATEGORIES))
                .withColumn("item_key", F.lower("item")).withColumn("_b", F.lit(n))
                .withColumn("q", number("quantity_to_purchase")).withColumn("t", number("total_quantity_needed")))

    p1, p2 = prep(b1, 1), prep(b2, 2)
    both = p1.unionByName(p2)
    in1, in2 = F.col("_b") == 1, F.col("_b") == 2
    q2, t2 = in2 & F.col("q").isNotNull(), in2 & F.col("q").isNotNull() & F.col("t").isNotNull()
    agg = both.groupBy(*keys).agg(
        F.max(F.when(in1, F.col("pos"))).alias("_last_pos"),
        F.min_by(F.when(in2, F.struct("item", "quantity_to_purchase", "total_quantity_needed", "unit", "q", "t")),
                 F.when(in2, F.col("pos"))).alias("first2"),
        F.sum(F.when(q2, F.col("q"))).alias("q2"), F.count(F.when(q2, 1)).alias("nq2"),
        F.sum(F.when(t2, F.col("t"))).alias("t2"), F.count(F.when(t2, 1)).alias("nt2"))

    def added(own: Column, also: Column, n: Column, least: int, total: Column, text: Column) -> Column:
        return F.when(own.isNotNull() & also.isNotNull() & (n >= least), total.cast("string")).otherwise(text)

    j = p1.join(agg, keys, "inner")
    base = F.col("pos") == F.col("_last_pos")
    q, t = F.when(base, F.col("q")), F.when(base, F.col("t"))
    merged1 = j.select(*keys, "item", "unit", "pos",
                       added(q, q, F.col("nq2"), 1, q + F.col("q2"), F.col("quantity_to_purchase")).alias("quantity_to_purchase"),
                       added(t, q, F.col("nt2"), 1, t + F.col("t2"), F.col("total_quantity_needed")).alias("total_quantity_needed"),
                       F.lit(1).alias("source_batch"))
    # the base is among the batch-2 rows that the sums hold
    q, t = F.col("first2.q"), F.col("first2.t")
    merged2 = agg.where(F.col("_last_pos").isNull()).select(
        *keys, F.col("first2.item").alias("item"), F.col("first2.unit").alias("unit"), F.lit(None).cast("long").alias("pos"),
        added(q, q, F.col("nq2"), 2, F.col("q2"), F.col("first2.quantity_to_purchase")).alias("quantity_to_purchase"),
        added(t, q, F.col("nt2"), 2, F.col("t2"), F.col("first2.total_quantity_needed")).alias("total_quantity_needed"),
        F.lit(2).alias("source_batch"))
    return merged1.unionByName(merged2)


def shopping_totals(t1: DataFrame, t2: DataFrame, key_cols=("plan_id",)) -> DataFrame:
    """D6, totals: estimated cost, items from the inventory and items to buy
    of both batches, summed per key of batch 1; a missing total counts as 0
    and so does a missing batch 2."""
    keys = list(key_cols)
    second = t2.select(*keys, *[F.col(c).alias(f"_{c}") for c in SHOPPING_TOTALS])
    return t1.join(second, keys, "left").select(
        *keys, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast("double" if c == "total_estimated_cost" else "long").alias(c)
                 for c in SHOPPING_TOTALS])


def shopping_merge_join(b1: DataFrame, b2: DataFrame, key_cols=("plan_id",)) -> DataFrame:
    """Which (key, category, lower(item)) occur in batch 1, 2 or both."""
    keys = list(key_cols) + ["category", "item_key"]
    k1 = b1.select(*key_cols, "category", F.lower("item").alias("item_key")).distinct().withColumn("in1", F.lit(True))
    k2 = b2.select(*key_cols, "category", F.lower("item").alias("item_key")).distinct().withColumn("in2", F.lit(True))
    return (k1.join(k2, keys, "full_outer")
            .select(*keys, F.coalesce("in1", F.lit(False)).alias("in_batch1"),
                    F.coalesce("in2", F.lit(False)).alias("in_batch2")))


def servings_join(profiles: DataFrame, foods: DataFrame) -> DataFrame:
    """Explode the servings map and join the food table by name
    (inner: unknown foods drop out)."""
    e = profiles.select("profile_id", F.explode("foods").alias("food_name", "servings"))
    return e.join(foods, "food_name", "inner")


def profile_totals(joined: DataFrame) -> DataFrame:
    """Per profile sum(servings x per-serving value); round 2/1/1."""
    return joined.groupBy("profile_id").agg(
        pyround(F.sum(F.col("calories") * F.col("servings")), 2).alias("calories"),
        pyround(F.sum(F.col("protein") * F.col("servings")), 1).alias("protein"),
        pyround(F.sum(F.col("sugar") * F.col("servings")), 1).alias("sugar"))
