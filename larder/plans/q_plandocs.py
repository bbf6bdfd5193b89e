"""Plan-document queries. Documents are assembled as JSON text from
orders + lineitem (one plan per order, one day per line) and then parsed by
the operators; the oracle computes the same results from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import schemas as sc
from larder.functions.mathfn import pyround_sql
from larder.operators import plandocs as pd_
from larder.operators.common import spread
from larder.plans.registry import register
from larder.sources.tables import table


def plan_documents(spark, d):
    """One JSON document per order.

    Only the plain columns of its lines are shuffled, sorted and collected; days,
    items and suggestions are many times as large and are put together row by
    row, right before they become text. Fields that are always null are left
    out of the structs: their JSON has none of them either.
    """
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spread(table(spark, d, "lineitem"), "l_orderkey")
    start = F.to_date("o_orderdate")
    lines = li.join(o, li.l_orderkey == o.o_orderkey)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", start.alias("start"))
    g = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("cost"),
        F.count(F.when(F.col("l_linestatus") == "O", 1)).cast("int").alias("from_inv"),
        F.count(F.lit(1)).cast("int").alias("n_items"))
    j = o.join(g, o.o_orderkey == g.l_orderkey, "left")
    easy, plain = (F.struct(F.lit(x).cast("string").alias("difficulty_level")) for x in ("easy", None))

    def meal(name, recipe, cal, **more):
        return F.struct(name.alias("meal_name"), recipe.alias("recipe"), F.struct(cal.cast("double").alias("calories")).alias("nutrition"),
                        *[c.alias(k) for k, c in more.items()])

    def day(x):
        ln, pk, sk, qty = x["l_linenumber"], x["l_partkey"], x["l_suppkey"], x["l_quantity"]
        day_name = F.when((ln <= 3) & (F.col("o_orderkey") % 4 == 0), F.lit("WrongName")) \
            .otherwise(F.date_format(F.date_add(x["start"], ln - 1), "EEEE"))
        nut = F.struct((qty * 20 + ln).alias("calories"), qty.alias("protein_g"), (ln * 10 + qty).alias("carbohydrates_g"),
                       F.floor(x["l_discount"] * 100).cast("double").alias("fat_g"), (qty / 10).alias("fiber_g"))
        meals = F.struct(
            meal(F.concat(F.lit("dish "), pk.cast("string")), easy, qty * 5, preparation_time=ln.cast("int"),
                 servings=F.lit(2), serving_size=F.lit("1 bowl")).alias("breakfast"),
            meal(F.when(sk % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("lunch "), sk.cast("string"))), plain, qty * 7).alias("lunch"),
            meal(F.concat(F.lit("dinner "), pk.cast("string")), plain, qty * 9, servings=F.lit(3)).alias("dinner"),
            F.when(ln == 3, F.lit(None)).otherwise(meal(F.concat(F.lit("snack "), ln.cast("string")), plain, qty)).alias("snacks"))
        return F.struct(ln.cast("int").alias("day"), day_name.alias("day_name"), nut.alias("total_nutrition"),
                        F.struct(ln.cast("int").alias("items_used"), F.lit(1).alias("new_purchases_needed")).alias("inventory_impact"),
                        meals.alias("meals"))

    def item(x):
        return F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("item"), x["l_quantity"].cast("string").alias("quantity_to_purchase"),
                        (x["l_quantity"] + 1).cast("string").alias("total_quantity_needed"), F.lit("g").alias("unit"))

    def suggestion(x):
        return F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("item"),
                        F.when(x["l_returnflag"] == "R", F.lit("low stock")).alias("reason"),
                        F.when(x["l_linestatus"] != "O", F.lit("Produce")).alias("category"),
                        x["l_quantity"].alias("suggested_quantity"), F.when(x["l_linenumber"] % 2 == 1, F.lit("kg")).alias("unit"))

    def of_lines(make, flag=None):
        some = F.col("lines") if flag is None else F.filter("lines", lambda x: x["l_returnflag"] == flag)
        return F.transform(some, make)

    def or_none(c):
        return F.coalesce(c, F.array())

    def document(sugg):
        shop = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.struct(
            *[or_none(of_lines(item, flag)).alias(k) for k, flag in (("proteins", "R"), ("produce", "N"), ("pantry_items", "A"))],
            F.coalesce(F.col("cost"), F.lit(0.0)).alias("total_estimated_cost"),
            F.coalesce(F.col("from_inv"), F.lit(0)).alias("total_items_from_inventory"),
            F.coalesce(F.col("n_items"), F.lit(0)).alias("total_items_to_purchase")))
        return F.to_json(F.struct(
            F.create_map(F.lit("user_id"), F.col("o_custkey").cast("string")).alias("user_summary"),
            F.struct(F.struct(or_none(sugg).alias("future_suggestions")).alias("week_summary"), or_none(of_lines(day)).alias("days")).alias("meal_plan"),
            F.struct(shop.alias("shopping_list_summary")).alias("recommendations"),
            F.when(F.col("o_orderkey") % 5 != 0, F.create_map(F.lit("source"), F.lit("generator"))).alias("metadata"),
            sugg.alias("future_suggestions")))
    return j.select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"), start.alias("start_date"),
                    F.explode(F.transform(F.array(of_lines(suggestion)), document)).alias("document"))


def parsed(spark, d, *fields):
    """The documents, of which ``fields`` are kept (all, if none is named)."""
    return pd_.parse_plan(plan_documents(spark, d), schema=sc.only(sc.PLAN_DOCUMENT, fields) if fields else sc.PLAN_DOCUMENT)


LINES = "SELECT l.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS start_date FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
MEALS_SQL = f"""SELECT l_orderkey AS plan_id, l_linenumber AS day_number, start_date + (l_linenumber - 1) AS meal_date, 'breakfast' AS meal_type,
  'dish ' || CAST(l_partkey AS VARCHAR) AS meal_name, CAST(l_linenumber AS INTEGER) AS preparation_time, 2 AS servings, '1 bowl' AS serving_size, 'easy' AS difficulty_level FROM ({LINES})
UNION ALL SELECT l_orderkey, l_linenumber, start_date + (l_linenumber - 1), 'lunch', CASE WHEN l_suppkey % 2 = 0 THEN 'Unknown Meal' ELSE 'lunch ' || CAST(l_suppkey AS VARCHAR) END,
  0, 1, '1 serving', 'medium' FROM ({LINES})
UNION ALL SELECT l_orderkey, l_linenumber, start_date + (l_linenumber - 1), 'dinner', 'dinner ' || CAST(l_partkey AS VARCHAR), 0, 3, '1 serving', 'medium' FROM ({LINES})
UNION ALL SELECT l_orderkey, l_linenumber, start_date + (l_linenumber - 1), 'snacks', 'snack ' || CAST(l_linenumber AS VARCHAR), 0, 1, '1 serving', 'medium' FROM ({LINES}) WHERE l_linenumber != 3"""
MEAL_COLS = ["plan_id", "day_number", "meal_date", "meal_type", "meal_name", "preparation_time", "servings", "serving_size", "difficulty_level"]


@register("flatten_plan", MEALS_SQL)
def q_flatten_plan(spark, d):
    meal = ("meal_name", "preparation_time", "cooking_time", "servings", "serving_size", "recipe.difficulty_level", "nutrition.calories")
    t = pd_.flatten_plan(parsed(spark, d, "meal_plan.days.day", "meal_plan.days.day_name", "meal_plan.days.total_nutrition", *[f"meal_plan.days.meals.{m}" for m in meal],
                                "meal_plan.week_summary", "recommendations.shopping_list_summary"), ["plan_id"])
    return t["meal_details"].select(*MEAL_COLS)


@register("validate_plan", """SELECT o_orderkey AS plan_id, NOT (o_orderkey % 5 = 0 OR n IS NULL) AS is_valid,
  CASE WHEN o_orderkey % 5 = 0 THEN 'missing metadata' WHEN n IS NULL THEN 'no days' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def q_validate_plan(spark, d):
    return pd_.validate_plan(plan_documents(spark, d)).select("plan_id", "is_valid", "reason")


@register("fix_day_names", f"""SELECT plan_id, CAST(pos AS INTEGER) AS pos, old_day_name, CAST(pos + 1 AS INTEGER) AS fixed_day, strftime(start_date + CAST(pos AS INTEGER), '%A') AS fixed_day_name FROM (
  SELECT l_orderkey AS plan_id, start_date, CASE WHEN l_linenumber <= 3 AND l_orderkey % 4 = 0 THEN 'WrongName' ELSE strftime(start_date + (l_linenumber - 1), '%A') END AS old_day_name,
    ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM ({LINES}))""")
def q_fix_day_names(spark, d):
    f = pd_.fix_day_names(parsed(spark, d, "meal_plan.days.day_name"))
    return f.select("plan_id", F.col("pos").cast("int").alias("pos"), F.col("d.day_name").alias("old_day_name"),
                    F.col("fixed_day").cast("int").alias("fixed_day"), "fixed_day_name")


@register("plan_suggestions", f"""SELECT l_orderkey AS plan_id, 'part ' || CAST(l_partkey AS VARCHAR) AS item,
  CASE WHEN l_returnflag = 'R' THEN 'low stock' ELSE '' END AS reason, CASE WHEN l_linestatus != 'O' THEN 'Produce' ELSE 'General' END AS category,
  l_quantity AS suggested_quantity, CASE WHEN l_linenumber % 2 = 1 THEN 'kg' ELSE 'unit' END AS unit FROM ({LINES})""")
def q_plan_suggestions(spark, d):
    return pd_.plan_suggestions(parsed(spark, d, "future_suggestions"), ["plan_id"]).drop("pos")


@register("shopping_list_items", f"""SELECT l_orderkey AS plan_id, CASE l_returnflag WHEN 'R' THEN 'proteins' WHEN 'N' THEN 'produce' ELSE 'pantry_items' END AS category,
  'part ' || CAST(l_partkey AS VARCHAR) AS item, CAST(l_quantity AS VARCHAR) AS quantity_to_purchase, 'g' AS unit FROM ({LINES}) WHERE l_orderkey % 7 != 0""")
def q_shopping_list_items(spark, d):
    return shopping_items(spark, d)


def shopping_items(spark, d):
    return pd_.shopping_list_items(parsed(spark, d, "recommendations.shopping_list_summary"), ["plan_id"]).drop("pos")


@register("week_summary", f"""SELECT plan_id, CAST(trunc(list_reduce(cal, lambda a, b: a + b) / n) AS INTEGER) AS average_daily_calories,
  {pyround_sql('list_reduce(prot, lambda a, b: a + b) / n', 1)} AS average_daily_protein, {pyround_sql('list_reduce(carb, lambda a, b: a + b) / n', 1)} AS average_daily_carbs,
  {pyround_sql('list_reduce(fat, lambda a, b: a + b) / n', 1)} AS average_daily_fat, {pyround_sql('list_reduce(fib, lambda a, b: a + b) / n', 1)} AS average_daily_fiber,
  CAST(n AS BIGINT) AS num_days FROM (
  SELECT l_orderkey AS plan_id, COUNT(*) AS n, list(l_quantity * 20 + l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS cal,
    list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS prot, list(l_linenumber * 10 + l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS carb,
    list(CAST(floor(l_discount * 100) AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_suppkey) AS fat,
    list(l_quantity / 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS fib FROM ({LINES}) GROUP BY l_orderkey)""")
def q_week_summary(spark, d):
    return pd_.week_summary(parsed(spark, d, "meal_plan.days.total_nutrition"), ["plan_id"])


@register("inventory_utilization", f"""SELECT l_orderkey AS plan_id, CASE WHEN COUNT(*) > 0 THEN {pyround_sql('least(COUNT(CASE WHEN l_linestatus = ' + "'O'" + ' THEN 1 END) * 3 * 100.0 / COUNT(*), 100.0)', 1)} ELSE 0.0 END AS utilization_rate
FROM lineitem WHERE l_orderkey % 7 != 0 GROUP BY l_orderkey""")
def q_inventory_utilization(spark, d):
    shop = F.col("doc.recommendations.shopping_list_summary")
    totals = ("total_items_from_inventory", "total_items_to_purchase")
    p = parsed(spark, d, *[f"recommendations.shopping_list_summary.{t}" for t in totals]).where(shop.isNotNull() & (shop["total_items_to_purchase"] > 0))
    return p.select("plan_id", pd_.inventory_utilization(shop["total_items_from_inventory"] * 3,
                                                         shop["total_items_to_purchase"]).alias("utilization_rate"))


@register("write_plan_tables", """SELECT 'meal_plans' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders
UNION ALL SELECT 'daily_meals', CAST(COUNT(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'meal_details', CAST(SUM(CASE WHEN l_linenumber = 3 THEN 3 ELSE 4 END) AS BIGINT) FROM lineitem
UNION ALL SELECT 'shopping_lists', CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_orderkey % 7 != 0""")
def q_write_plan_tables(spark, d):
    from larder.session import run_dir
    from larder.sources.sinks import write_plan_tables
    tables = write_plan_tables(pd_.plan_rows(parsed(spark, d), ["plan_id", "user_id"]), run_dir(spark, "larder/write_plan_tables"))
    counts = [df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _meal_rows(spark, d):
    from larder.plans import analogues as an
    from larder.functions import jsonfn
    det = an.meal_details(spark, d)
    return det.select("detail_id", "meal_id", "meal_name", jsonfn.nutrition("nutrition")["calories"].alias("calories"),
                      "day_number")


@register("merge_meal_update", """SELECT meal_id, round(SUM(COALESCE(calories, 0.0)), 1) AS calories FROM (
  SELECT l_orderkey * 10 + l_linenumber AS meal_id, CASE WHEN l_linenumber = 2 THEN 999.0 WHEN l_linenumber = 7 THEN NULL
    ELSE l_quantity * 20 + l_linenumber END AS calories FROM lineitem) GROUP BY meal_id""")
def q_merge_meal_update(spark, d):
    rows = _meal_rows(spark, d)
    upd = rows.where(F.col("day_number") == 2).select("detail_id", F.concat(F.lit("updated "), F.col("meal_name")).alias("meal_name"),
                                                      F.lit(999.0).alias("calories"))
    merged, _misses = pd_.merge_meal_update(rows, upd)
    return merged.groupBy("meal_id").agg(F.round(F.sum(F.coalesce(F.col("calories"), F.lit(0.0))), 1).alias("calories"))


def _meal_table(spark, d):
    """Stored meals with unique ids, and updates of which some name no meal."""
    from larder.session import run_dir
    from larder.sources.merge import MergeTable
    rows = _meal_rows(spark, d).dropDuplicates(["meal_id"]).select("meal_id", F.col("day_number").cast("long").alias("day_number"))
    t = MergeTable(spark, run_dir(spark, "larder/merge_meals"), "meal_id", 16)
    t.create(rows)
    upd = rows.where("meal_id % 9 = 0").select(F.when(F.col("meal_id") % 2 == 0, -F.col("meal_id")).otherwise(F.col("meal_id")).alias("meal_id"),
                                               F.lit(99).cast("long").alias("day_number"))
    return t, t.update(upd, ["day_number"])


_MEAL_IDS = "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS meal_id, CAST(l_linenumber AS BIGINT) AS day_number FROM lineitem"


@register("merge_meal_table", f"SELECT meal_id, CASE WHEN meal_id % 9 = 0 AND meal_id % 2 <> 0 THEN 99 ELSE day_number END AS day_number FROM ({_MEAL_IDS})")
def q_merge_meal_table(spark, d):
    return _meal_table(spark, d)[0].read()


@register("merge_meal_misses", f"SELECT -meal_id AS meal_id FROM ({_MEAL_IDS}) WHERE meal_id % 9 = 0 AND meal_id % 2 = 0 AND meal_id <> 0")
def q_merge_meal_misses(spark, d):
    return _meal_table(spark, d)[1].select("meal_id")


@register("replace_suggestions", """SELECT o_orderkey AS plan_id, CAST(1 AS BIGINT) AS n_suggestions, 'oats for ' || CAST(o_custkey AS VARCHAR) AS item
FROM orders WHERE o_orderkey % 3 = 0""")
def q_replace_suggestions(spark, d):
    plans = parsed(spark, d, "meal_plan.week_summary")
    item = F.struct(F.concat(F.lit("oats for "), F.col("user_id").cast("string")).alias("item"), F.lit("liked").alias("reason"), F.lit("Grains").alias("category"),
                    F.lit(2.0).alias("suggested_quantity"), F.lit("kg").alias("unit"))
    new = plan_documents(spark, d).where("plan_id % 3 = 0").select("plan_id", F.array(item).alias("items"))
    out = pd_.replaced_suggestions(plans, new, ["plan_id"])
    back = out.select("plan_id", F.from_json("week_summary", sc.WEEK_SUMMARY)["future_suggestions"].alias("s"))
    return back.select("plan_id", F.size("s").cast("long").alias("n_suggestions"), F.col("s")[0]["item"].alias("item"))
