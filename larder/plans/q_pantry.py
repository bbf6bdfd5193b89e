"""Pantry queries: units, inventory grouping, reply normalization, shopping
merge and serving totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.mathfn import pyround_sql
from larder.operators import marts as m
from larder.operators import pantry as pt
from larder.plans import analogues as an
from larder.plans.q_marts import MART_MEAL_PLANNING_SQL
from larder.plans.registry import register
from larder.sources.tables import table

INV = an.INVENTORY_SQL


def _contains_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def standardize_sql(q, unit, item):
    u = f"lower(trim(coalesce({unit}, '')))"
    it = f"lower(coalesce({item}, ''))"
    dflt = "CASE " + " ".join(f"WHEN contains({u}, '{w}') THEN {ml}::DOUBLE" for w, ml in pt.CONTAINER_DEFAULT_ML) + " END"
    wt = "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {mlt}::DOUBLE" for k, mlt, _ in pt.WEIGHT_UNITS) + " END"
    vol = "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {mlt}::DOUBLE" for k, mlt, _ in pt.VOLUME_UNITS) + " END"
    cont = _contains_any(u, pt.LIQUID_CONTAINERS)
    liq = _contains_any(it, pt.LIQUID_KEYWORDS)
    cnt = _contains_any(u, pt.COUNT_WORDS)
    qv = f"CAST({q} AS DOUBLE)"
    sq = (f"CASE WHEN {cont} AND NOT {cnt} AND ({dflt}) IS NOT NULL THEN {pyround_sql(f'{qv} * ({dflt})', 2)} "
          f"WHEN {liq} AND {cont} THEN {pyround_sql(f'{qv} * 500.0', 2)} "
          f"WHEN ({wt}) IS NOT NULL THEN {pyround_sql(f'{qv} * ({wt})', 2)} "
          f"WHEN ({vol}) IS NOT NULL THEN {pyround_sql(f'{qv} * ({vol})', 2)} ELSE {qv} END")
    su = (f"CASE WHEN {cont} AND NOT {cnt} AND ({dflt}) IS NOT NULL THEN 'ml' WHEN {liq} AND {cont} THEN 'ml' "
          f"WHEN ({wt}) IS NOT NULL THEN 'gm' WHEN ({vol}) IS NOT NULL THEN 'ml' ELSE 'pieces' END")
    return sq, su


_SQ, _SU = standardize_sql("quantity", "unit", "item_name")


@register("standardize_unit", f"SELECT inventory_id, quantity, unit, item_name, {_SQ} AS std_quantity, {_SU} AS std_unit FROM ({INV})")
def q_standardize_unit(spark, d):
    inv = pt.with_standard_unit(an.inventory(spark, d), "quantity", "unit", "item_name")
    return inv.select("inventory_id", "quantity", "unit", "item_name", F.col("std.std_quantity").alias("std_quantity"),
                      F.col("std.std_unit").alias("std_unit"))


UNIT_DIM_SQL = "(VALUES " + ", ".join(f"('{k}', {mlt}::DOUBLE, '{u}')" for k, mlt, u in pt.WEIGHT_UNITS + pt.VOLUME_UNITS) + \
    ") AS ud(unit_key, multiplier, std_unit)"


@register("unit_dim_join", f"""SELECT i.inventory_id, i.unit_key, ud.multiplier, ud.std_unit
FROM (SELECT inventory_id, lower(trim(unit)) AS unit_key FROM ({INV})) i LEFT JOIN {UNIT_DIM_SQL} USING (unit_key)""")
def q_unit_dim_join(spark, d):
    return pt.unit_dim_join(an.inventory(spark, d), spark).select("inventory_id", "unit_key", "multiplier", "std_unit")


@register("in_stock_inventory", f"SELECT inventory_id, user_id, quantity FROM ({INV}) WHERE quantity > 0")
def q_in_stock_inventory(spark, d):
    return pt.in_stock_inventory(an.inventory(spark, d)).select("inventory_id", "user_id", "quantity")


_INV_CAT = "CASE WHEN category IS NULL OR category = '' THEN 'Other' ELSE category END"


@register("inventory_by_category", f"""SELECT user_id, category, inventory_id, item_name, CAST(
  ROW_NUMBER() OVER (PARTITION BY user_id, category ORDER BY item_name, inventory_id) AS INTEGER) AS item_rank
FROM (SELECT user_id, {_INV_CAT} AS category, inventory_id, item_name FROM ({INV}))""")
def q_inventory_by_category(spark, d):
    return pt.inventory_by_category(an.inventory(spark, d)).select(
        "user_id", "category", "inventory_id", "item_name", "item_rank")


@register("category_item_counts", f"""SELECT p.user_id, p.category, p.n_items, t.total_items FROM
  (SELECT user_id, {_INV_CAT} AS category, CAST(COUNT(*) AS BIGINT) AS n_items FROM ({INV}) GROUP BY 1, 2) p
  JOIN (SELECT user_id, CAST(COUNT(*) AS BIGINT) AS total_items FROM ({INV}) GROUP BY 1) t USING (user_id)""")
def q_category_item_counts(spark, d):
    return pt.category_item_counts(an.inventory(spark, d))


def _replies(spark, d):
    """Model replies assembled from part rows: fenced list, bare object,
    prose, and a list with an unknown category and missing fields."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    obj = F.concat(F.lit('{"item_name": "'), name, F.lit('", "quantity": '), size,
                   F.lit(', "unit": "pcs", "category": "Produce"}'))
    content = (F.when(k == 0, F.concat(F.lit("Here you go:\n```json\n["), obj, F.lit(', {"item_name": "'), F.col("p_brand"),
                                       F.lit('", "quantity": "2", "category": "Beverages"}]\n```\nthanks')))
               .when(k == 1, obj)
               .when(k == 2, F.concat(F.lit("I could not read the photo of "), name, F.lit(" on the shelf, sorry about that.")))
               .otherwise(F.concat(F.lit('[{"quantity": '), F.when(F.col("p_partkey") % 8 == 7, F.lit('"two"')).otherwise(size), F.lit(', "category": "Tools"}, {"item_name": "'), name,
                                   F.lit('"}]'))))
    return p.select(F.col("p_partkey").alias("reply_id"), content.alias("content"))


_REPLIES_SQL = """SELECT p_partkey AS reply_id, CASE p_partkey % 4
  WHEN 0 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '[' || '{"item_name": "' || p_name || '", "quantity": ' || CAST(p_size AS VARCHAR) || ', "unit": "pcs", "category": "Produce"}' || ', {"item_name": "' || p_brand || '", "quantity": "2", "category": "Beverages"}]' || chr(10) || '```' || chr(10) || 'thanks'
  WHEN 1 THEN '{"item_name": "' || p_name || '", "quantity": ' || CAST(p_size AS VARCHAR) || ', "unit": "pcs", "category": "Produce"}'
  WHEN 2 THEN 'I could not read the photo of ' || p_name || ' on the shelf, sorry about that.'
  ELSE '[{"quantity": ' || CASE WHEN p_partkey % 8 = 7 THEN '"two"' ELSE CAST(p_size AS VARCHAR) END || ', "category": "Tools"}, {"item_name": "' || p_name || '"}]' END AS content FROM part"""

_VALID = ", ".join(f"'{c}'" for c in pt.VALID_INVENTORY_CATEGORIES)


NORMALIZE_SQL = f"""WITH r AS ({_REPLIES_SQL}),
b AS (SELECT reply_id, content, regexp_replace(CASE WHEN starts_with(i, 'json') THEN substr(i, 5) ELSE i END, '^\\s+|\\s+$', '', 'g') AS body
      FROM (SELECT reply_id, content, CASE WHEN contains(content, '```') THEN split_part(content, '```', 2) ELSE content END AS i FROM r)),
k AS (SELECT reply_id, content, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN '[' || body || ']'
      WHEN json_valid(body) AND json_type(body) = 'ARRAY' THEN body END AS arr FROM b),
j AS (SELECT reply_id, content, from_json(arr, '[{{"item_name":"VARCHAR","quantity":"VARCHAR","unit":"VARCHAR","category":"VARCHAR"}}]') AS items FROM k),
l AS (SELECT reply_id, CASE WHEN items IS NOT NULL AND len(list_filter(items, lambda x: x.quantity IS NOT NULL AND TRY_CAST(x.quantity AS DOUBLE) IS NULL)) = 0 THEN items
      ELSE [{{'item_name': substr(content, 1, 50), 'quantity': '1', 'unit': 'unit', 'category': 'Other'}}] END AS items FROM j),
u AS (SELECT reply_id, generate_subscripts(items, 1) - 1 AS item_pos, unnest(items) AS it FROM l)
SELECT reply_id, CAST(item_pos AS INTEGER) AS item_pos, COALESCE(it.item_name, 'Unknown Item') AS item,
  COALESCE(TRY_CAST(it.quantity AS DOUBLE), 1.0) AS quantity, COALESCE(it.unit, 'unit') AS unit,
  CASE WHEN it.category IN ({_VALID}) THEN it.category ELSE 'Other' END AS category FROM u"""


@register("normalize_inventory", NORMALIZE_SQL)
def q_normalize_inventory(spark, d):
    return pt.normalize_inventory(_replies(spark, d))


def _batches(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    cats = pt.SHOPPING_CATEGORIES + ["snacks"]
    cat = F.element_at(F.array(*[F.lit(c) for c in cats]), (F.col("l_partkey") % 8 + 1).cast("int"))
    rows = j.select(F.col("l_orderkey").alias("plan_id"), cat.alias("category"),
                    F.when(F.col("l_linenumber") >= 5, F.upper("p_name")).otherwise(F.col("p_name")).alias("item"),
                    F.when(F.col("l_linenumber") % 4 == 3, F.lit("a few")).when((F.col("l_linenumber") == 6) & (F.col("l_partkey") % 3 == 0), F.lit(None).cast("string")).otherwise(F.col("l_quantity").cast("string"))
                     .alias("quantity_to_purchase"),
                    F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 2 == 0), F.lit("some")).otherwise((F.col("l_quantity") + 1).cast("string")).alias("total_quantity_needed"),
                    F.lit("pcs").alias("unit"),
                    (F.col("l_linenumber") * F.lit(10 ** 12) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pos"),
                    "l_linenumber")
    return (rows.where(F.col("l_linenumber") <= 4).drop("l_linenumber"),
            rows.where(F.col("l_linenumber") >= 5).drop("l_linenumber"))


_CATS = ", ".join(f"'{c}'" for c in pt.SHOPPING_CATEGORIES + ["snacks"])
_BATCH_SQL = f"""SELECT l_orderkey AS plan_id, [{_CATS}][l_partkey % 8 + 1] AS category,
  CASE WHEN l_linenumber >= 5 THEN upper(p_name) ELSE p_name END AS item,
  CASE WHEN l_linenumber % 4 = 3 THEN 'a few' WHEN l_linenumber = 6 AND l_partkey % 3 = 0 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS quantity_to_purchase,
  CASE WHEN l_linenumber = 5 AND l_partkey % 2 = 0 THEN 'some' ELSE CAST(l_quantity + 1 AS VARCHAR) END AS total_quantity_needed, 'pcs' AS unit,
  l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, l_linenumber
FROM lineitem JOIN part ON l_partkey = p_partkey"""
_VALIDCATS = ", ".join(f"'{c}'" for c in pt.SHOPPING_CATEGORIES)
_B1 = f"SELECT *, lower(item) AS item_key, TRY_CAST(COALESCE(quantity_to_purchase, '0') AS DOUBLE) AS q, TRY_CAST(COALESCE(total_quantity_needed, '0') AS DOUBLE) AS t FROM ({_BATCH_SQL}) WHERE l_linenumber <= 4 AND category IN ({_VALIDCATS})"
_B2 = f"SELECT *, lower(item) AS item_key, TRY_CAST(COALESCE(quantity_to_purchase, '0') AS DOUBLE) AS q, TRY_CAST(COALESCE(total_quantity_needed, '0') AS DOUBLE) AS t FROM ({_BATCH_SQL}) WHERE l_linenumber >= 5 AND category IN ({_VALIDCATS})"


# Base rows with what the other batch-2 rows of the name add.
@register("shopping_consolidation", f"""WITH b1 AS ({_B1}), b2 AS ({_B2}),
base AS (
  SELECT plan_id, category, item_key, item, unit, quantity_to_purchase, total_quantity_needed, q, t, pos, 1 AS source_batch,
    pos = max(pos) OVER (PARTITION BY plan_id, category, item_key) AS takes FROM b1
  UNION ALL
  SELECT plan_id, category, item_key, item, unit, quantity_to_purchase, total_quantity_needed, q, t, pos, 2, TRUE FROM b2
  WHERE NOT EXISTS (FROM b1 WHERE b1.plan_id = b2.plan_id AND b1.category = b2.category AND b1.item_key = b2.item_key)
  QUALIFY row_number() OVER (PARTITION BY plan_id, category, item_key ORDER BY pos) = 1),
more AS (
  SELECT base.plan_id, base.category, base.item_key, base.pos, sum(b2.q) AS q2, sum(CASE WHEN b2.q IS NOT NULL THEN b2.t END) AS t2
  FROM base JOIN b2 ON base.takes AND base.plan_id = b2.plan_id AND base.category = b2.category AND base.item_key = b2.item_key
    AND NOT (base.source_batch = 2 AND base.pos = b2.pos) GROUP BY 1, 2, 3, 4)
SELECT base.plan_id, base.category, base.item_key, item, unit,
  CASE WHEN q + q2 IS NOT NULL THEN CAST(q + q2 AS VARCHAR) ELSE quantity_to_purchase END AS quantity_to_purchase,
  CASE WHEN q IS NOT NULL AND t + t2 IS NOT NULL THEN CAST(t + t2 AS VARCHAR) ELSE total_quantity_needed END AS total_quantity_needed, source_batch
FROM base LEFT JOIN more ON more.plan_id = base.plan_id AND more.category = base.category AND more.item_key = base.item_key
  AND more.pos = base.pos AND base.takes""")
def q_shopping_consolidation(spark, d):
    b1, b2 = _batches(spark, d)
    return pt.shopping_consolidation(b1, b2).drop("pos")


@register("shopping_merge_join", f"""SELECT COALESCE(a.plan_id, b.plan_id) AS plan_id, COALESCE(a.category, b.category) AS category,
  COALESCE(a.item_key, b.item_key) AS item_key, a.plan_id IS NOT NULL AS in_batch1, b.plan_id IS NOT NULL AS in_batch2
FROM (SELECT DISTINCT plan_id, category, lower(item) AS item_key FROM ({_BATCH_SQL}) WHERE l_linenumber <= 4) a
FULL OUTER JOIN (SELECT DISTINCT plan_id, category, lower(item) AS item_key FROM ({_BATCH_SQL}) WHERE l_linenumber >= 5) b
  ON a.plan_id = b.plan_id AND a.category = b.category AND a.item_key = b.item_key""")
def q_shopping_merge_join(spark, d):
    b1, b2 = _batches(spark, d)
    return pt.shopping_merge_join(b1, b2)


def _profiles(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    e = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey", "p_name")
         .agg(F.sum(F.col("l_quantity") / 10).alias("servings")))
    per = e.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "servings"))).alias("foods"))
    return per.select(F.col("l_orderkey").alias("profile_id"),
                      F.map_concat("foods", F.create_map(F.lit("unknown dish"), F.lit(1.0))).alias("foods"))


def _food_table(spark, d):
    mart = m.mart_meal_planning(an.macros(spark, d))
    return mart.select("food_name", "calories", "protein", F.col("carbohydrate").alias("sugar"))


_SERV_SQL = f"""SELECT s.profile_id, s.food_name, s.servings, f.calories, f.protein, f.sugar FROM (
  SELECT l_orderkey AS profile_id, p_name AS food_name, SUM(l_quantity / 10) AS servings FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2) s JOIN (SELECT food_name, calories, protein, carbohydrate AS sugar FROM ({MART_MEAL_PLANNING_SQL})) f
  ON s.food_name = f.food_name"""


@register("servings_join", f"SELECT profile_id, food_name, round(servings, 6) AS servings, calories FROM ({_SERV_SQL})")
def q_servings_join(spark, d):
    j = pt.servings_join(_profiles(spark, d), _food_table(spark, d))
    return j.select("profile_id", "food_name", F.round("servings", 6).alias("servings"), "calories")


@register("profile_totals", f"""SELECT profile_id, {pyround_sql('SUM(calories * servings)', 2)} AS calories,
  {pyround_sql('SUM(protein * servings)', 1)} AS protein, {pyround_sql('SUM(sugar * servings)', 1)} AS sugar
FROM ({_SERV_SQL}) GROUP BY profile_id""")
def q_profile_totals(spark, d):
    return pt.profile_totals(pt.servings_join(_profiles(spark, d), _food_table(spark, d)))


@register("shopping_totals", """WITH t AS (SELECT l_orderkey AS plan_id, l_linenumber >= 5 AS second,
    sum(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END) AS cost, sum(l_linenumber) AS inv, count(*) AS buy FROM lineitem GROUP BY 1, 2)
SELECT a.plan_id, round(coalesce(a.cost, 0) + coalesce(b.cost, 0), 4) AS total_estimated_cost,
  CAST(a.inv + coalesce(b.inv, 0) AS BIGINT) AS total_items_from_inventory, CAST(a.buy + coalesce(b.buy, 0) AS BIGINT) AS total_items_to_purchase
FROM t a LEFT JOIN t b ON a.plan_id = b.plan_id AND b.second WHERE NOT a.second""")
def q_shopping_totals(spark, d):
    """D6, totals: lines up to 4 are the first batch of a plan, the rest the
    second; some lines have no price."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    g = li.groupBy(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") >= 5).alias("second")).agg(
        F.sum(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))).alias("total_estimated_cost"),
        F.sum("l_linenumber").alias("total_items_from_inventory"), F.count(F.lit(1)).alias("total_items_to_purchase"))
    out = pt.shopping_totals(g.where("NOT second"), g.where("second"))
    return out.withColumn("total_estimated_cost", F.round("total_estimated_cost", 4))
