"""Domain tables expressed over the driver tables.

Every builder returns a lazy DataFrame computed from the driver parquet
tables, and every one has an SQL twin (``*_SQL``) that the DuckDB oracle
uses, so both sides compute the same inputs. The mappings are invented
analogues (they are not reference data): they only give each operator a
same-shaped input that grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.common import spread
from larder.sources.tables import table

# ---------------------------------------------------------------- foods ----
# raw_food <- part

def raw_food(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("fdc_id"), F.col("p_brand").alias("data_type"),
        F.col("p_name").alias("description"), F.col("p_type").alias("food_category"))


RAW_FOOD_SQL = """SELECT p_partkey AS fdc_id, p_brand AS data_type, p_name AS description,
  p_type AS food_category FROM part"""

# raw_food_nutrient <- lineitem: nutrient code from (returnflag, linestatus),
# amount = quantity - 5 so negatives and zeros exist.

def raw_food_nutrient(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("fdc_id"),
        (F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")).cast("long").alias("nutrient_id"),
        (F.col("l_quantity") - 5).alias("amount"),
        F.col("l_linenumber").alias("data_points"),
        F.col("l_discount").alias("min_value"), F.col("l_tax").alias("max_value"),
        F.col("l_extendedprice").alias("median_value"),
        (F.col("l_discount") * 100).alias("percent_daily_value"))


RAW_FOOD_NUTRIENT_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS fdc_id,
  CAST(ascii(l_returnflag) * 100 + ascii(l_linestatus) AS BIGINT) AS nutrient_id,
  l_quantity - 5 AS amount, l_linenumber AS data_points, l_discount AS min_value,
  l_tax AS max_value, l_extendedprice AS median_value, l_discount * 100 AS percent_daily_value
  FROM lineitem"""

# The whole file of food nutrients: all 13 columns in the file's order.

def raw_food_nutrient_file(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    note = F.when(F.col("l_linenumber") == 3, F.concat(F.lit('see "note", '), F.col("l_returnflag"))).when(F.col("l_linenumber") == 5, F.lit("trace, below limit"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("fdc_id"),
        (F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")).cast("long").alias("nutrient_id"),
        (F.col("l_quantity") - 5).alias("amount"), F.col("l_linenumber").alias("data_points"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") % 50).cast("int")).alias("derivation_id"),
        F.col("l_discount").alias("min_value"), F.col("l_tax").alias("max_value"), F.col("l_extendedprice").alias("median_value"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("<"), F.col("l_linenumber").cast("string"))).alias("loq"), note.alias("footnote"),
        F.year("l_shipdate").alias("min_year_acquired"), (F.col("l_discount") * 100).alias("percent_daily_value"))


RAW_FOOD_NUTRIENT_FILE_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS fdc_id, CAST(ascii(l_returnflag) * 100 + ascii(l_linestatus) AS BIGINT) AS nutrient_id,
  l_quantity - 5 AS amount, l_linenumber AS data_points, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 50 AS INTEGER) END AS derivation_id,
  l_discount AS min_value, l_tax AS max_value, l_extendedprice AS median_value, CASE WHEN l_linenumber = 1 THEN '<1' END AS loq,
  CASE l_linenumber WHEN 3 THEN 'see "note", ' || l_returnflag WHEN 5 THEN 'trace, below limit' END AS footnote,
  CAST(year(l_shipdate) AS INTEGER) AS min_year_acquired, l_discount * 100 AS percent_daily_value FROM lineitem"""

# raw_nutrient: code table for the six (returnflag, linestatus) codes.
# Fixed analogue values: (id, name, unit_name, nutrient_nbr, rank_order).
NUTRIENT_CODES = [
    (6570, "Energy", "KCAL", 208.0, 300.0),
    (6579, "Protein", "G", 203.0, 600.0),
    (7870, "Total lipid (fat)", "G", 204.0, 800.0),
    (7879, "Carbohydrate, by difference", "G", 205.0, 1110.0),
    (8270, "Fiber, total dietary", "G", 291.0, 1200.0),
    (8279, " Sodium, Na ", "MG", 307.0, 5800.0),
]
NUTRIENT_SCHEMA = "id long, name string, unit_name string, nutrient_nbr double, rank_order double"


def raw_nutrient(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(NUTRIENT_CODES, NUTRIENT_SCHEMA)


RAW_NUTRIENT_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, '{n}', '{u}', {a}::DOUBLE, {b}::DOUBLE)" for i, n, u, a, b in NUTRIENT_CODES
) + ") AS t(id, name, unit_name, nutrient_nbr, rank_order)"

# The code table cut to the codes that the facts use, read off the facts.

def raw_nutrient_used(spark: SparkSession, d: str) -> DataFrame:
    used = raw_food_nutrient(spark, d).select("nutrient_id").distinct()
    of = F.map_from_entries(F.array(*[F.struct(F.lit(i).cast("long"), F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "unit_name", "nutrient_nbr", "rank_order"), r)]))
                                      for i, *r in NUTRIENT_CODES]))
    return used.select(F.col("nutrient_id").alias("id"), F.element_at(of, F.col("nutrient_id")).alias("c")).select("id", "c.*").where("name IS NOT NULL")


RAW_NUTRIENT_USED_SQL = f"SELECT * FROM ({RAW_NUTRIENT_SQL}) WHERE id IN (SELECT nutrient_id FROM ({RAW_FOOD_NUTRIENT_SQL}))"

# raw_food_portion <- lineitem with the discount as gram weight (0 exists).

def raw_food_portion(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("fdc_id"), F.col("l_linenumber").alias("seq_num"),
        F.col("l_quantity").alias("amount"), F.col("l_linenumber").alias("measure_unit_id"),
        F.concat(F.col("l_returnflag"), F.lit(" portion")).alias("portion_description"),
        F.col("l_linestatus").alias("modifier"),
        (F.col("l_discount") * 100).alias("gram_weight"))


RAW_FOOD_PORTION_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS fdc_id,
  l_linenumber AS seq_num, l_quantity AS amount, l_linenumber AS measure_unit_id,
  l_returnflag || ' portion' AS portion_description, l_linestatus AS modifier,
  l_discount * 100 AS gram_weight FROM lineitem"""

# The whole file of portions: all 11 columns.

def raw_food_portion_file(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "lineitem").withColumn("_note", F.when(F.col("l_linenumber") == 4, F.lit('about 1", cut')))
    return more.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("fdc_id"), F.col("l_linenumber").alias("seq_num"),
        F.col("l_quantity").alias("amount"), F.col("l_linenumber").alias("measure_unit_id"), F.concat(F.col("l_returnflag"), F.lit(" portion")).alias("portion_description"),
        F.col("l_linestatus").alias("modifier"), (F.col("l_discount") * 100).alias("gram_weight"),
        F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("data_points"), F.col("_note").alias("footnote"), F.year("l_shipdate").alias("min_year_acquired"))


RAW_FOOD_PORTION_FILE_SQL = RAW_FOOD_PORTION_SQL.replace(" FROM lineitem", """,
  CASE WHEN l_linenumber <> 2 THEN l_linenumber END AS data_points, CASE WHEN l_linenumber = 4 THEN 'about 1", cut' END AS footnote,
  CAST(year(l_shipdate) AS INTEGER) AS min_year_acquired FROM lineitem""")

# ----------------------------------------------------- staged SQL twins ----
STG_FOOD_SQL = f"""SELECT fdc_id, data_type, lower(trim(description)) AS food_name,
  food_category AS category FROM ({RAW_FOOD_SQL})
  WHERE description IS NOT NULL AND description != '' AND fdc_id IS NOT NULL"""

STG_FOOD_NUTRIENT_SQL = f"""SELECT id AS food_nutrient_id, fdc_id, nutrient_id,
  COALESCE(amount, 0) AS nutrient_amount, data_points, min_value, max_value, median_value,
  percent_daily_value FROM ({RAW_FOOD_NUTRIENT_SQL})
  WHERE fdc_id IS NOT NULL AND nutrient_id IS NOT NULL AND amount >= 0"""

STG_NUTRIENT_SQL = f"""SELECT id AS nutrient_id, trim(name) AS nutrient_name, unit_name,
  nutrient_nbr, rank_order FROM ({RAW_NUTRIENT_SQL}) WHERE name IS NOT NULL"""

def _macronutrients_sql() -> str:
    """Per food and pattern the greatest positive amount, pivoted from the
    pattern table of ``operators.staging``; foods without any have no row."""
    from larder.operators import staging as st
    patterns = ", ".join(f"('{name}', '{text}')" for name, text in st.MACRO_PATTERNS)
    columns = ", ".join(f"max(amount) FILTER (WHERE measure = '{name}') AS {name}" for name, _ in st.MACRO_PATTERNS)
    return f"""WITH amounts AS (
  SELECT fdc_id, nutrient_amount AS amount, measure FROM ({STG_FOOD_NUTRIENT_SQL})
  LEFT JOIN ({STG_NUTRIENT_SQL}) USING (nutrient_id) LEFT JOIN (VALUES {patterns}) AS wanted(measure, text) ON nutrient_name LIKE text
  WHERE nutrient_amount > 0),
  widest AS (SELECT fdc_id, {columns} FROM amounts GROUP BY fdc_id)
SELECT fdc_id, food_name, category, data_type, widest.* EXCLUDE (fdc_id) FROM ({STG_FOOD_SQL}) JOIN widest USING (fdc_id)"""


INT_MACRONUTRIENTS_SQL = _macronutrients_sql()


def staged(spark: SparkSession, d: str):
    """(stg_food, stg_food_nutrient, stg_nutrient) over the analogues."""
    from larder.operators import staging as st
    return (st.stg_food(raw_food(spark, d)),
            st.stg_food_nutrient(raw_food_nutrient(spark, d)),
            st.stg_nutrient(raw_nutrient(spark, d)))


def macros(spark: SparkSession, d: str) -> DataFrame:
    from larder.operators import staging as st
    return st.int_macronutrients(*staged(spark, d))


# ------------------------------------------------------- application ----
# Fixed analogue value: the "today" every date rule is evaluated against.
AS_OF = "1998-08-02"


def _case(col, pairs, default=None):
    expr = None
    for k, v in pairs:
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _case_sql(col, pairs, default=None):
    body = " ".join(f"WHEN {k!r} THEN {v!r}" if isinstance(k, str) else f"WHEN {k} THEN {v!r}"
                    for k, v in pairs)
    tail = f" ELSE {default!r}" if default is not None else ""
    return f"CASE {col} {body}{tail} END"


ACTIVITY_BY_SEGMENT = [("AUTOMOBILE", "Sedentary"), ("BUILDING", "Lightly active"),
                       ("FURNITURE", "Moderately active"), ("HOUSEHOLD", "Very active"),
                       ("MACHINERY", "Extremely active")]
GOAL_BY_MOD = [(0, "Weight Loss"), (1, "Weight Gain"), (2, "Muscle Gain"), (3, "Maintain Weight")]
RESTRICTIONS_BY_MOD = [(0, "None"), (1, "Vegetarian, Gluten-Free"), (2, " Vegan ,Halal, Paleo")]


def users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    activity = F.when(F.col("c_nationkey") == 24, F.lit("Athlete")).otherwise(
        _case(F.col("c_mktsegment"), ACTIVITY_BY_SEGMENT))
    return c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
        (F.lit(150.0) + F.col("c_nationkey") * 2).cast("double").alias("height_cm"),
        (F.lit(45.0) + F.floor(F.abs(F.col("c_acctbal")) / 25) / 10).alias("weight_kg"),
        activity.alias("activity_level"),
        _case(F.col("c_nationkey") % 4, GOAL_BY_MOD).alias("health_goal"),
        _case(F.col("c_custkey") % 3, RESTRICTIONS_BY_MOD).alias("dietary_restrictions"),
        F.col("c_nationkey").alias("nation_key"))


USERS_SQL = f"""SELECT c_custkey AS user_id, c_name AS username, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(150.0 + c_nationkey * 2 AS DOUBLE) AS height_cm,
  45.0 + floor(abs(c_acctbal) / 25) / 10 AS weight_kg,
  CASE WHEN c_nationkey = 24 THEN 'Athlete' ELSE {_case_sql('c_mktsegment', ACTIVITY_BY_SEGMENT)} END AS activity_level,
  {_case_sql('c_nationkey % 4', GOAL_BY_MOD)} AS health_goal,
  {_case_sql('c_custkey % 3', RESTRICTIONS_BY_MOD)} AS dietary_restrictions,
  c_nationkey AS nation_key FROM customer"""


def schedules(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("schedule_id"), F.col("o_custkey").alias("user_id"),
                    start.alias("plan_start_date"), F.date_add(start, 7).alias("plan_end_date"),
                    F.date_add(start, 7).alias("next_plan_date"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")).alias("status"),
                    F.col("o_orderdate").alias("created_at"))


SCHEDULES_SQL = """SELECT o_orderkey AS schedule_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS plan_start_date,
  CAST(o_orderdate AS DATE) + 7 AS plan_end_date, CAST(o_orderdate AS DATE) + 7 AS next_plan_date,
  CASE WHEN o_orderstatus = 'F' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, o_orderdate AS created_at FROM orders"""

PLAN_STATUS = [("O", "ACTIVE"), ("F", "COMPLETED"), ("P", "PENDING")]


def meal_plans(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderkey").alias("schedule_id"),
                    start.alias("start_date"), F.date_add(start, 6).alias("end_date"),
                    _case(F.col("o_orderstatus"), PLAN_STATUS).alias("status"),
                    F.col("o_orderdate").alias("created_at"),
                    F.col("o_totalprice").alias("total_price"))


MEAL_PLANS_SQL = f"""SELECT o_orderkey AS plan_id, o_custkey AS user_id, o_orderkey AS schedule_id,
  CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 6 AS end_date,
  {_case_sql('o_orderstatus', PLAN_STATUS)} AS status, o_orderdate AS created_at,
  o_totalprice AS total_price FROM orders"""

MEAL_TYPE_BY_MOD = [(0, "breakfast"), (1, "lunch"), (2, "dinner"), (3, "snacks"), (4, "brunch")]


def meal_details(spark: SparkSession, d: str) -> DataFrame:
    """One meal per lineitem row; nutrition as JSON text (invalid on line 7,
    without fiber on line 6), ingredients as a JSON array of two objects."""
    li = table(spark, d, "lineitem")
    cal = F.col("l_quantity") * 20 + F.col("l_linenumber")
    nut = F.struct(cal.alias("calories"), F.col("l_quantity").alias("protein_g"),
                   (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("carbohydrates_g"),
                   F.floor(F.col("l_discount") * 100).cast("double").alias("fat_g"),
                   (F.col("l_quantity") / 10).alias("fiber_g"))
    nut_nofiber = F.struct(cal.alias("calories"), F.col("l_quantity").alias("protein_g"),
                           (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("carbohydrates_g"),
                           F.floor(F.col("l_discount") * 100).cast("double").alias("fat_g"))
    nutrition = (F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
                 .when(F.col("l_linenumber") == 6, F.to_json(nut_nofiber))
                 .otherwise(F.to_json(nut)))
    ingredients = F.to_json(F.array(
        F.struct(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("ingredient"),
                 F.col("l_quantity").alias("quantity"), F.lit("g").alias("unit"),
                 (F.col("l_linestatus") == "O").alias("from_inventory")),
        F.struct(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" sauce")).alias("ingredient"),
                 F.col("l_tax").alias("quantity"), F.lit("ml").alias("unit"),
                 F.lit(False).alias("from_inventory"))))
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("detail_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("meal_id"),
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("day_number"),
        _case(F.col("l_suppkey") % 5, MEAL_TYPE_BY_MOD).alias("meal_type"),
        F.concat(F.lit("dish "), F.col("l_partkey").cast("string")).alias("meal_name"),
        nutrition.alias("nutrition"), ingredients.alias("ingredients"),
        F.col("l_linenumber").cast("int").alias("preparation_time"),
        F.col("l_quantity").cast("int").alias("servings"),
        F.to_date("l_shipdate").alias("ship_date"))


MEAL_DETAILS_SQL = f"""SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS detail_id,
  l_orderkey * 10 + l_linenumber AS meal_id, l_orderkey AS plan_id, l_linenumber AS day_number,
  {_case_sql('l_suppkey % 5', MEAL_TYPE_BY_MOD)} AS meal_type, 'dish ' || CAST(l_partkey AS VARCHAR) AS meal_name,
  CASE WHEN l_linenumber = 7 THEN 'n/a'
       WHEN l_linenumber = 6 THEN json_object('calories', l_quantity * 20 + l_linenumber, 'protein_g', l_quantity,
         'carbohydrates_g', l_linenumber * 10 + l_quantity, 'fat_g', CAST(floor(l_discount * 100) AS DOUBLE))::VARCHAR
       ELSE json_object('calories', l_quantity * 20 + l_linenumber, 'protein_g', l_quantity,
         'carbohydrates_g', l_linenumber * 10 + l_quantity, 'fat_g', CAST(floor(l_discount * 100) AS DOUBLE),
         'fiber_g', l_quantity / 10)::VARCHAR END AS nutrition,
  json_array(json_object('ingredient', 'Part ' || CAST(l_partkey AS VARCHAR), 'quantity', l_quantity, 'unit', 'g',
      'from_inventory', l_linestatus = 'O'),
    json_object('ingredient', 'supplier ' || CAST(l_suppkey AS VARCHAR) || ' sauce', 'quantity', l_tax, 'unit', 'ml',
      'from_inventory', false))::VARCHAR AS ingredients,
  CAST(l_linenumber AS INTEGER) AS preparation_time, CAST(l_quantity AS INTEGER) AS servings,
  CAST(l_shipdate AS DATE) AS ship_date FROM lineitem"""


#: Days of a plan: no meal is later than this after its plan's start.
PLAN_DAYS = 7


def daily_meals(spark: SparkSession, d: str, since: str | None = None) -> DataFrame:
    """One row per (plan, day) with the user and date taken from the plan.

    With ``since`` only plans that can have a day from then on are read: the
    date bounds the orders, and their least and greatest key bound the scan of
    lineitem before the join, so old row groups are skipped.
    """
    li = spread(table(spark, d, "lineitem"), "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if since is not None:
        o = o.where(F.col("o_orderdate") >= F.date_sub(F.lit(since).cast("date"), PLAN_DAYS - 1).cast("timestamp_ntz"))
        ends = o.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
        li = li.where((F.col("l_orderkey") >= ends.select("lo").scalar()) & (F.col("l_orderkey") <= ends.select("hi").scalar()))
        li = li.join(o.select("o_orderkey"), li.l_orderkey == o.o_orderkey, "left_semi")
    days = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_meals"),
        F.sum(F.col("l_quantity") * 20 + F.col("l_linenumber")).alias("calories"),
        F.sum("l_quantity").alias("protein_g"),
        F.sum(F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("carbohydrates_g"),
        F.sum(F.floor(F.col("l_discount") * 100).cast("double")).alias("fat_g"),
        F.sum(F.col("l_quantity") / 10).alias("fiber_g"))
    total = (F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
             .when(F.col("l_linenumber") == 6, F.lit("oops{"))
             .otherwise(F.to_json(F.struct("calories", "protein_g", "carbohydrates_g", "fat_g", "fiber_g"))))
    j = days.join(o, days.l_orderkey == o.o_orderkey, "inner")
    meal_date = F.date_add(F.to_date("o_orderdate"), F.col("l_linenumber") - 1)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("meal_id"),
                    F.col("l_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"),
                    F.col("l_linenumber").alias("day_number"), meal_date.alias("meal_date"),
                    F.date_format(meal_date, "EEEE").alias("day_name"),
                    F.col("n_meals").cast("long").alias("n_meals"), total.alias("total_nutrition"))


DAILY_MEALS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS meal_id, l_orderkey AS plan_id, o_custkey AS user_id,
  l_linenumber AS day_number, CAST(o_orderdate AS DATE) + (l_linenumber - 1) AS meal_date,
  strftime(CAST(o_orderdate AS DATE) + (l_linenumber - 1), '%A') AS day_name, CAST(n_meals AS BIGINT) AS n_meals,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'oops{'
       ELSE json_object('calories', calories, 'protein_g', protein_g, 'carbohydrates_g', carbohydrates_g,
                        'fat_g', fat_g, 'fiber_g', fiber_g)::VARCHAR END AS total_nutrition
FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS n_meals, SUM(l_quantity * 20 + l_linenumber) AS calories,
        SUM(l_quantity) AS protein_g, SUM(l_linenumber * 10 + l_quantity) AS carbohydrates_g,
        SUM(CAST(floor(l_discount * 100) AS DOUBLE)) AS fat_g, SUM(l_quantity / 10) AS fiber_g
      FROM lineitem GROUP BY l_orderkey, l_linenumber) d
JOIN orders o ON d.l_orderkey = o.o_orderkey"""

UNIT_BY_LINE = [(1, "cups"), (2, "lbs"), (3, "fl oz"), (4, "can"), (5, "bunch"), (6, " G "), (7, "box of cans")]
LIQUID_SUFFIX = [(0, " milk"), (1, " juice"), (2, ""), (3, " flour")]
INV_CATEGORY_BY_TYPE = [("ECONOMY", "Proteins"), ("SMALL", "Produce"), ("MEDIUM", "Dairy"),
                        ("LARGE", "Grains"), ("PROMO", "")]


def inventory(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("inventory_id"),
        F.col("l_suppkey").alias("user_id"),
        F.concat(F.col("p_name"), _case(F.col("l_partkey") % 4, LIQUID_SUFFIX)).alias("item_name"),
        (F.col("l_quantity") - 10).alias("quantity"),
        _case(F.col("l_linenumber"), UNIT_BY_LINE).alias("unit"),
        _case(F.col("p_type"), INV_CATEGORY_BY_TYPE).alias("category"))


INVENTORY_SQL = f"""SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS inventory_id,
  l_suppkey AS user_id, p_name || {_case_sql('l_partkey % 4', LIQUID_SUFFIX)} AS item_name, l_quantity - 10 AS quantity,
  {_case_sql('l_linenumber', UNIT_BY_LINE)} AS unit, {_case_sql('p_type', INV_CATEGORY_BY_TYPE)} AS category
FROM lineitem JOIN part ON l_partkey = p_partkey"""

FEEDBACK_TYPE_BY_EVENT = [("click", "like"), ("purchase", "temporal_preference"), ("error", "dislike"),
                          ("view", "temporal_preference"), ("signup", "dietary_restriction")]


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return feedback_from(table(spark, d, "events"))


def feedback_from(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("feedback_id"), "user_id",
        _case(F.col("event_type"), FEEDBACK_TYPE_BY_EVENT).alias("feedback_type"),
        F.when(F.col("event_type") == "view", F.lit("cuisine")).otherwise(F.lit("food")).alias("entity_type"),
        F.concat(F.lit("item"), (k % 12).cast("string")).alias("entity_name"),
        F.when(F.col("event_type") == "error", F.lit("negative")).otherwise(F.lit("positive")).alias("sentiment"),
        (F.col("value").cast("int") % 5 + 1).cast("int").alias("intensity"),
        F.when(F.col("value") < 20, F.lit("next_week")).when(F.col("value") < 60, F.lit("this_month"))
         .alias("timing"),
        F.col("ts").alias("extracted_at"), F.col("value").alias("value"))


FEEDBACK_SQL = f"""SELECT event_id AS feedback_id, user_id,
  {_case_sql('event_type', FEEDBACK_TYPE_BY_EVENT)} AS feedback_type,
  CASE WHEN event_type = 'view' THEN 'cuisine' ELSE 'food' END AS entity_type,
  'item' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 12 AS VARCHAR) AS entity_name,
  CASE WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS sentiment,
  CAST(CAST(trunc(value) AS INTEGER) % 5 + 1 AS INTEGER) AS intensity,
  CASE WHEN value < 20 THEN 'next_week' WHEN value < 60 THEN 'this_month' END AS timing,
  ts AS extracted_at, value FROM events"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    return messages_from(table(spark, d, "conversations"))


def messages_from(c: DataFrame) -> DataFrame:
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn div 2 as int), 0)")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
                    F.col("conv_id").alias("thread_id"), "turn", "role",
                    F.col("text").alias("content"), created.alias("created_at"))


MESSAGES_SQL = """SELECT conv_id * 100 + turn AS message_id, conv_id AS thread_id, turn, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn // 2) AS created_at FROM conversations"""


def threads(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return (m.groupBy("thread_id")
            .agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
            .select("thread_id", (F.col("thread_id") % 20).alias("user_id"),
                    (F.col("thread_id") % 7 != 0).alias("is_active"), "created_at", "updated_at"))


THREADS_SQL = f"""SELECT thread_id, thread_id % 20 AS user_id, thread_id % 7 != 0 AS is_active, created_at, updated_at
FROM (SELECT thread_id, min(created_at) AS created_at, max(created_at) AS updated_at
      FROM ({MESSAGES_SQL}) GROUP BY thread_id)"""

INTENT_BY_QUALITY = [(0, "general_chat"), (1, "meal_retrieval")]


def eval_log(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation log: documents scored by labels; run = source, date from run."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "inner")
    run_no = F.substring("source", 4, 10).cast("int")
    return j.select(
        F.col("source").alias("run_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (run_no / 2).cast("int")).alias("execution_date"),
        F.col("lang").alias("model_version"), F.col("doc_id").alias("id"),
        F.col("text").alias("input"),
        _case(F.col("quality"), INTENT_BY_QUALITY).alias("expected_intent"),
        F.when(F.col("toxic") == 1, F.lit("ERROR")).otherwise(_case(F.col("quality"), INTENT_BY_QUALITY))
         .alias("actual_intent"),
        F.col("quality").cast("double").alias("score_accuracy"),
        (F.col("n_chars") % 5 + 1).cast("double").alias("score_quality"),
        F.when(F.col("toxic") == 1, F.lit("timeout")).alias("error"))


EVAL_LOG_SQL = f"""SELECT source AS run_id, DATE '2024-01-01' + CAST(substr(source, 4, 10) AS INTEGER) // 2 AS execution_date,
  lang AS model_version, doc_id AS id, text AS input, {_case_sql('quality', INTENT_BY_QUALITY)} AS expected_intent,
  CASE WHEN toxic = 1 THEN 'ERROR' ELSE {_case_sql('quality', INTENT_BY_QUALITY)} END AS actual_intent,
  CAST(quality AS DOUBLE) AS score_accuracy, CAST(n_chars % 5 + 1 AS DOUBLE) AS score_quality,
  CASE WHEN toxic = 1 THEN 'timeout' END AS error
FROM documents JOIN labels USING (doc_id)"""


# Analogue model names per event type (two of them carry published MAE values).
MODEL_BY_EVENT = [("click", "Llama 3.1 8B"), ("purchase", "GPT-3.5-turbo"), ("view", "Mistral 7B"),
                  ("signup", "Gemma 7B"), ("error", "Phi-3 Mini")]
MODELS = [m for _, m in MODEL_BY_EVENT]


def model_results(spark: SparkSession, d: str) -> DataFrame:
    """Mid-term result rows: model = event type, profile from the user."""
    e = table(spark, d, "events")
    target = (F.lit(1500) + (F.col("user_id") % 10) * 100).cast("double")
    actual = F.when(F.col("value") > 300, F.lit(0.0)).otherwise(target + (F.col("value") - 50) * 5)
    err = F.abs(actual - target)
    return e.select(
        F.col("event_id").alias("result_id"), _case(F.col("event_type"), MODEL_BY_EVENT).alias("Model"),
        F.concat(F.lit("P"), (F.col("user_id") % 5 + 1).cast("string")).alias("Profile"),
        target.alias("Target_Calories"), actual.alias("Actual_Calories"), err.alias("Error_kcal"),
        (err / target * 100).alias("Error_Percent"), (F.col("value") / 10).alias("Processing_Time"),
        ((err / target * 100) < 100).alias("Success"))


MODEL_RESULTS_SQL = f"""SELECT result_id, Model, Profile, Target_Calories, Actual_Calories, Error_kcal,
  Error_kcal / Target_Calories * 100 AS Error_Percent, Processing_Time, (Error_kcal / Target_Calories * 100) < 100 AS Success
FROM (SELECT event_id AS result_id, {_case_sql('event_type', MODEL_BY_EVENT)} AS Model, 'P' || CAST(user_id % 5 + 1 AS VARCHAR) AS Profile,
  CAST(1500 + (user_id % 10) * 100 AS DOUBLE) AS Target_Calories,
  CASE WHEN value > 300 THEN 0.0 ELSE CAST(1500 + (user_id % 10) * 100 AS DOUBLE) + (value - 50) * 5 END AS Actual_Calories,
  abs(CASE WHEN value > 300 THEN 0.0 ELSE CAST(1500 + (user_id % 10) * 100 AS DOUBLE) + (value - 50) * 5 END
      - CAST(1500 + (user_id % 10) * 100 AS DOUBLE)) AS Error_kcal,
  value / 10 AS Processing_Time FROM events)"""


def arena_results(spark: SparkSession, d: str) -> DataFrame:
    """Model-arena rows: model = document source, scores from labels."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "n_chars", "lang")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("model_name"),
        (F.col("n_chars") / 1000.0).alias("latency"),
        (F.coalesce(F.col("quality"), F.lit(0)) * 7 + F.coalesce(F.col("toxic"), F.lit(0)) * 3).cast("double")
         .alias("groundedness_score"),
        (F.col("n_chars") / 4).cast("long").alias("input_tokens"),
        (F.col("n_chars") % 97 + 1).cast("long").alias("output_tokens"),
        F.col("lang").alias("food_name"), F.col("text").alias("response"))


ARENA_SQL = """SELECT doc_id AS row_id, source AS model_name, n_chars / 1000.0 AS latency,
  CAST(COALESCE(quality, 0) * 7 + COALESCE(toxic, 0) * 3 AS DOUBLE) AS groundedness_score,
  CAST(trunc(n_chars / 4) AS BIGINT) AS input_tokens, CAST(n_chars % 97 + 1 AS BIGINT) AS output_tokens,
  lang AS food_name, text AS response FROM documents LEFT JOIN labels USING (doc_id)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("fdc_id"), F.col("label").alias("category"), "embedding")


VECTORS_SQL = "SELECT vec_id AS fdc_id, label AS category, embedding FROM embeddings"
