"""Sources and sinks: CSV and JSON loads, registry, materialization,
appends. Writes go under the shared checkpoint folder and are read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators import marts as m
from larder.operators import pantry as pt
from larder.plans import analogues as an
from larder.plans.q_marts import MART_MEAL_PLANNING_SQL
from larder.plans.registry import register
from larder.session import run_dir
from larder.sources import files as fs
from larder.sources import sinks as sk
from larder.sources.tables import table

RAW_FOOD_SCHEMA = T.StructType([T.StructField("fdc_id", T.LongType()), T.StructField("data_type", T.StringType()),
                                T.StructField("description", T.StringType()), T.StructField("food_category", T.StringType())])
RAW_FOOD_NUTRIENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("fdc_id", T.LongType()), T.StructField("nutrient_id", T.LongType()),
    T.StructField("amount", T.DoubleType()), T.StructField("data_points", T.IntegerType()), T.StructField("derivation_id", T.IntegerType()),
    T.StructField("min_value", T.DoubleType()), T.StructField("max_value", T.DoubleType()), T.StructField("median_value", T.DoubleType()),
    T.StructField("loq", T.StringType()), T.StructField("footnote", T.StringType()), T.StructField("min_year_acquired", T.IntegerType()),
    T.StructField("percent_daily_value", T.DoubleType())])


def _food_with_null_spellings(spark, d):
    f = an.raw_food(spark, d)
    k = F.col("fdc_id")
    desc = (F.when(k % 11 == 0, F.lit("NULL")).when(k % 13 == 0, F.lit("null")).when(k % 17 == 0, F.lit(""))
            .when(k % 19 == 0, F.concat(F.col("description"), F.lit(", with \"quotes\"")))
            .otherwise(F.col("description")))
    return f.withColumn("description", desc)


_FOOD_NULLS_SQL = f"""SELECT fdc_id, data_type, CASE WHEN fdc_id % 11 = 0 OR fdc_id % 13 = 0 OR fdc_id % 17 = 0 THEN NULL
  WHEN fdc_id % 19 = 0 THEN description || ', with "quotes"' ELSE description END AS description, food_category FROM ({an.RAW_FOOD_SQL})"""


def _csv_round_trip(spark, d, key):
    path = run_dir(spark, f"larder/{key}/food_csv")
    fs.write_csv(_food_with_null_spellings(spark, d), path)
    return path


@register("scan_csv_typed", _FOOD_NULLS_SQL)
def q_scan_csv_typed(spark, d):
    return fs.read_csv_typed(spark, _csv_round_trip(spark, d, "scan_csv_typed"), RAW_FOOD_SCHEMA)


@register("copy_into_raw_food", _FOOD_NULLS_SQL)
def q_copy_into_raw_food(spark, d):
    # positional projection with casts (a bad value fails the load); the load
    # keeps rows without a description, staging drops them
    raw = fs.read_csv_typed(spark, _csv_round_trip(spark, d, "copy_into_raw_food"), RAW_FOOD_SCHEMA)
    return raw.select(*[raw.columns[i] for i in range(4)])


@register("copy_into_raw_food_nutrient", an.RAW_FOOD_NUTRIENT_FILE_SQL)
def q_copy_into_raw_food_nutrient(spark, d):
    path = run_dir(spark, "larder/copy_into_raw_food_nutrient/csv")
    fs.write_csv(an.raw_food_nutrient_file(spark, d), path)
    return fs.read_csv_typed(spark, path, RAW_FOOD_NUTRIENT_SCHEMA)


@register("scan_preview", f"SELECT * FROM ({an.RAW_FOOD_SQL}) ORDER BY fdc_id LIMIT 10")
def q_scan_preview(spark, d):
    # A preview of n rows; ordered by the key so it is repeatable
    return an.raw_food(spark, d).orderBy("fdc_id").limit(10)


@register("raw_profile_counts", f"""SELECT 'raw_food' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM ({an.RAW_FOOD_SQL})
UNION ALL SELECT 'raw_food_nutrient', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_FOOD_NUTRIENT_SQL})
UNION ALL SELECT 'raw_food_portion', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_FOOD_PORTION_SQL})
UNION ALL SELECT 'raw_nutrient', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_NUTRIENT_SQL})""")
def q_raw_profile_counts(spark, d):
    out = None
    for name, fn in (("raw_food", an.raw_food), ("raw_food_nutrient", an.raw_food_nutrient),
                     ("raw_food_portion", an.raw_food_portion), ("raw_nutrient", an.raw_nutrient)):
        c = fn(spark, d).agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def raw_food_category(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_type").agg(F.min("p_partkey").alias("id")).select(
        "id", F.col("p_type").alias("code"), F.lower("p_type").alias("description"))


def raw_measure_unit(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").cast("long").alias("id")).distinct().select(
        "id", F.concat(F.lit("unit "), F.col("id").cast("string")).alias("name"))


# Source name -> loader (the dbt sources file as a dict).
SOURCES = {
    "raw_food": an.raw_food, "raw_nutrient": an.raw_nutrient, "raw_food_nutrient": an.raw_food_nutrient,
    "raw_food_portion": an.raw_food_portion, "raw_food_category": raw_food_category, "raw_measure_unit": raw_measure_unit,
}


@register("source_registry", f"""SELECT 'raw_food' AS source_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM ({an.RAW_FOOD_SQL})
UNION ALL SELECT 'raw_nutrient', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_NUTRIENT_SQL})
UNION ALL SELECT 'raw_food_nutrient', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_FOOD_NUTRIENT_SQL})
UNION ALL SELECT 'raw_food_portion', CAST(COUNT(*) AS BIGINT) FROM ({an.RAW_FOOD_PORTION_SQL})
UNION ALL SELECT 'raw_food_category', CAST(COUNT(DISTINCT p_type) AS BIGINT) FROM part
UNION ALL SELECT 'raw_measure_unit', CAST(COUNT(DISTINCT l_linenumber) AS BIGINT) FROM lineitem""")
def q_source_registry(spark, d):
    out = None
    for name, loader in SOURCES.items():
        loader(spark, d).createOrReplaceTempView(f"larder_src_{name}")
        c = spark.table(f"larder_src_{name}").agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
            .select(F.lit(name).alias("source_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("materialize_view", MART_MEAL_PLANNING_SQL)
def q_materialize_view(spark, d):
    m.mart_meal_planning(an.macros(spark, d)).createOrReplaceTempView("larder_mart_meal_planning_view")
    return spark.table("larder_mart_meal_planning_view")


@register("materialize_table", MART_MEAL_PLANNING_SQL)
def q_materialize_table(spark, d):
    return sk.materialize_table(m.mart_meal_planning(an.macros(spark, d)), run_dir(spark, "larder/materialize_table/mart"))


@register("insert_select_from_temp_view", "SELECT item_id AS id, 64 AS dim, 'hash-64' AS model_name, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM benchmark")
def q_insert_select_from_temp_view(spark, d):
    """Rows computed in Spark -> temp view -> typed INSERT ... SELECT with
    constant columns into a table (a parquet folder), then read back."""
    from larder.operators import vectors as vx
    emb = vx.hash_embedding(table(spark, d, "benchmark"), "text", "item_id", 64)
    emb.createOrReplaceTempView("larder_new_vectors")
    target = run_dir(spark, "larder/insert_select/vectors")
    spark.createDataFrame([], "id long, dim int, model_name string, created_at timestamp_ntz, embedding array<double>") \
        .write.mode("overwrite").parquet(target)
    rows = spark.sql("""SELECT CAST(item_id AS BIGINT) AS id, size(embedding) AS dim, 'hash-64' AS model_name,
                               TIMESTAMP_NTZ'2024-02-01 00:00:00' AS created_at, embedding FROM larder_new_vectors""")
    rows.write.mode("append").parquet(target)
    return spark.read.parquet(target).select("id", "dim", "model_name", "created_at")


@register("truncate_reload", f"SELECT fdc_id, food_name FROM ({MART_MEAL_PLANNING_SQL})")
def q_truncate_reload(spark, d):
    """Empty then load (overwrite), twice: the second load replaces the first."""
    path = run_dir(spark, "larder/truncate_reload/mart")
    mart = m.mart_meal_planning(an.macros(spark, d)).select("fdc_id", "food_name")
    sk.materialize_table(mart, path)
    return sk.materialize_table(mart, path)


def eval_log_upper(log, run_id: str, execution_ts: dt.datetime, model_version: str):
    """Add run id, execution timestamp and model version, upper-case
    the column names."""
    x = (log.withColumn("run_id", F.lit(run_id)).withColumn("execution_date", F.lit(execution_ts).cast("timestamp_ntz"))
         .withColumn("model_version", F.lit(model_version)))
    return x.toDF(*[c.upper() for c in x.columns])


@register("append_eval_log", f"""SELECT 'manual__2024-01-15' AS RUN_ID, TIMESTAMP '2024-01-15 06:00:00' AS EXECUTION_DATE, 'v1.0' AS MODEL_VERSION,
  id AS ID, expected_intent AS EXPECTED_INTENT, actual_intent AS ACTUAL_INTENT, score_accuracy AS SCORE_ACCURACY, score_quality AS SCORE_QUALITY,
  error AS ERROR, DATE '2024-01-15' AS EXECUTION_DAY FROM ({an.EVAL_LOG_SQL})""")
def q_append_eval_log(spark, d):
    log = an.eval_log(spark, d).drop("run_id", "execution_date", "model_version", "input")
    up = eval_log_upper(log, "manual__2024-01-15", dt.datetime(2024, 1, 15, 6), "v1.0")
    up = up.withColumn("EXECUTION_DAY", F.to_date("EXECUTION_DATE"))
    path = run_dir(spark, "larder/append_eval_log/evaluation_logs")
    up.limit(0).write.mode("overwrite").partitionBy("EXECUTION_DAY").parquet(path)
    sk.append_table(up, path, ["EXECUTION_DAY"])
    return spark.read.parquet(path)


@register("write_results_csv", an.MODEL_RESULTS_SQL)
def q_write_results_csv(spark, d):
    path = run_dir(spark, "larder/results_csv/written")
    res = an.model_results(spark, d)
    fs.write_csv(res, path)
    return fs.read_csv_typed(spark, path, res.schema)


@register("read_results_csv", f"SELECT Model, CAST(COUNT(*) AS BIGINT) AS n, round(avg(Error_Percent), 6) AS avg_error FROM ({an.MODEL_RESULTS_SQL}) GROUP BY Model")
def q_read_results_csv(spark, d):
    path = run_dir(spark, "larder/results_csv/read")
    res = an.model_results(spark, d)
    fs.write_csv(res, path)
    back = fs.read_csv_typed(spark, path, res.schema)
    return back.groupBy("Model").agg(F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg("Error_Percent"), 6).alias("avg_error"))


CASE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("input", T.StringType()),
    T.StructField("expected_intent", T.StringType()), T.StructField("expected_entities", T.MapType(T.StringType(), T.StringType())),
    T.StructField("complexity", T.StringType())])


@register("read_eval_cases_json", """SELECT 'case_' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'safety' ELSE 'general' END AS category,
  CASE quality WHEN 0 THEN 'general_chat' ELSE 'meal_retrieval' END AS expected_intent,
  CAST(CASE WHEN quality = 1 THEN 2 ELSE 0 END AS INTEGER) AS n_entities, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS complexity FROM labels""")
def q_read_eval_cases_json(spark, d):
    lab = table(spark, d, "labels")
    ents = F.when(F.col("quality") == 1, F.create_map(F.lit("food"), F.lit("oats"), F.lit("meal_type"), F.lit("breakfast"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    cases = lab.select(F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("id"),
                       F.when(F.col("toxic") == 1, F.lit("safety")).otherwise(F.lit("general")).alias("category"),
                       F.lit("what should I eat").alias("input"),
                       an._case(F.col("quality"), an.INTENT_BY_QUALITY).alias("expected_intent"),
                       ents.alias("expected_entities"),
                       F.when(F.col("doc_id") % 3 == 0, F.lit("high")).otherwise(F.lit("low")).alias("complexity"))
    path = run_dir(spark, "larder/eval_cases_json")
    cases.write.mode("overwrite").json(path)
    back = fs.read_json_cases(spark, path, CASE_SCHEMA)
    return back.select("id", "category", "expected_intent", F.size("expected_entities").cast("int").alias("n_entities"), "complexity")


def _case_array_files(spark, d):
    """Cases as files that hold one JSON array each, of one source's labels;
    every case of an id divisible by 10 is cut off in the middle."""
    lab = table(spark, d, "labels")
    i = F.col("doc_id")
    text = F.to_json(F.struct(F.concat(F.lit("case_"), i.cast("string")).alias("id"), F.lit("general").alias("category"),
                              F.concat(F.lit('say "hi", {'), i.cast("string"), F.lit("} [x]")).alias("input"),
                              an._case(F.col("quality"), an.INTENT_BY_QUALITY).alias("expected_intent"),
                              F.create_map(F.lit("query"), F.lit("oats")).alias("expected_entities"), F.lit("low").alias("complexity")))
    element = F.when(i % 10 == 0, F.concat(F.lit('{"id": "case_'), i.cast("string"), F.lit('", "category": '))).otherwise(text)
    group = lab.select((i % 4).alias("g"), i.alias("i"), element.alias("e")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("l"))
    array = F.concat(F.lit("[\n  "), F.array_join(F.col("l.e"), ",\n  "), F.lit("\n]\n"))
    path = run_dir(spark, "larder/eval_case_arrays")
    group.select(array.alias("value"), "g").write.partitionBy("g").option("lineSep", "\n\n").text(path)
    return path


_ARRAY_CASES = "SELECT 'case_' || CAST(doc_id AS VARCHAR) AS id, doc_id, quality FROM labels"


@register("read_eval_cases_array", f"""SELECT id, 'say "hi", {{' || CAST(doc_id AS VARCHAR) || '}} [x]' AS input,
  CASE quality WHEN 0 THEN 'general_chat' ELSE 'meal_retrieval' END AS expected_intent, 'oats' AS entity FROM ({_ARRAY_CASES}) WHERE doc_id % 10 <> 0""")
def q_read_eval_cases_array(spark, d):
    rows, _ = fs.read_json_array(spark, _case_array_files(spark, d), CASE_SCHEMA)
    return rows.select("id", "input", "expected_intent", F.col("expected_entities")["query"].alias("entity"))


@register("eval_case_rejects", f"""SELECT '{{"id": "' || id || '", "category":' AS reject FROM ({_ARRAY_CASES}) WHERE doc_id % 10 = 0""")
def q_eval_case_rejects(spark, d):
    _, rejects = fs.read_json_array(spark, _case_array_files(spark, d), CASE_SCHEMA)
    return rejects.select(F.col("text").alias("reject"))


@register("apply_table_defaults", f"""SELECT thread_id, user_id, CASE WHEN thread_id % 3 = 0 THEN 'New conversation' ELSE 'Thread ' || CAST(thread_id AS VARCHAR) END AS title,
  CAST(0 AS BIGINT) AS message_count, true AS is_active, sha256(CAST(user_id AS VARCHAR) || '|' || CAST(thread_id AS VARCHAR)) AS row_key FROM ({an.THREADS_SQL})""")
def q_apply_table_defaults(spark, d):
    t = an.threads(spark, d).select("thread_id", "user_id",
                                    F.when(F.col("thread_id") % 3 == 0, F.lit(None).cast("string"))
                                    .otherwise(F.concat(F.lit("Thread "), F.col("thread_id").cast("string"))).alias("title"),
                                    F.lit(None).cast("long").alias("message_count"), F.lit(None).cast("boolean").alias("is_active"),
                                    F.lit(None).cast("string").alias("row_key"))
    out = fs.apply_table_defaults(t, {"title": "New conversation", "message_count": 0, "is_active": True},
                                  id_col="row_key", id_from=["user_id", "thread_id"])
    return out.withColumn("message_count", F.col("message_count").cast("long"))


@register("add_column_if_absent", f"SELECT user_id, health_goal, NULL::VARCHAR AS preferred_cuisines FROM ({an.USERS_SQL})")
def q_add_column_if_absent(spark, d):
    u = an.users(spark, d).select("user_id", "health_goal")
    u = fs.add_column_if_absent(u, "preferred_cuisines", "string")
    return fs.add_column_if_absent(u, "health_goal", "string")  # present: unchanged


def _append_inventory_sql():
    from larder.plans.q_pantry import NORMALIZE_SQL, standardize_sql
    q, u = standardize_sql("quantity", "unit", "item")
    return f"SELECT reply_id AS user_id, item AS item_name, {q} AS quantity, {u} AS unit, category FROM ({NORMALIZE_SQL})"


@register("append_inventory", _append_inventory_sql())
def q_append_inventory(spark, d):
    """Extracted items (D24) with standardized units (D5) appended to an
    inventory table; returns the table read back."""
    from larder.plans.q_pantry import _replies
    items = pt.with_standard_unit(pt.normalize_inventory(_replies(spark, d)), "quantity", "unit", "item")
    rows = items.select(F.col("reply_id").alias("user_id"), F.col("item").alias("item_name"),
                        F.col("std.std_quantity").alias("quantity"), F.col("std.std_unit").alias("unit"), "category")
    path = run_dir(spark, "larder/append_inventory/inventory")
    rows.limit(0).write.mode("overwrite").parquet(path)
    sk.append_table(rows, path)
    return spark.read.parquet(path)


def _copy(spark, df, key, schema):
    """COPY INTO: write the source rows as CSV, then the typed positional load."""
    path = run_dir(spark, f"larder/{key}/csv")
    fs.write_csv(df, path)
    return fs.read_csv_typed(spark, path, schema)


NUTRIENT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                                T.StructField("unit_name", T.StringType()), T.StructField("nutrient_nbr", T.DoubleType()),
                                T.StructField("rank_order", T.DoubleType())])


@register("copy_into_raw_nutrient", f"""SELECT n.* FROM ({an.RAW_NUTRIENT_SQL}) n
  WHERE n.id IN (SELECT DISTINCT nutrient_id FROM ({an.RAW_FOOD_NUTRIENT_SQL}))""")
def q_copy_into_raw_nutrient(spark, d):
    # the nutrient rows the fact table uses (code table joined to the codes found)
    used = an.raw_food_nutrient(spark, d).select(F.col("nutrient_id").alias("id")).distinct()
    rows = F.broadcast(an.raw_nutrient(spark, d)).join(used, "id", "left_semi")
    return _copy(spark, rows, "copy_into_raw_nutrient", NUTRIENT_SCHEMA)


@register("copy_into_raw_food_category", "SELECT min(p_partkey) AS id, p_type AS code, lower(p_type) AS description FROM part GROUP BY p_type")
def q_copy_into_raw_food_category(spark, d):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.StringType()),
                           T.StructField("description", T.StringType())])
    return _copy(spark, raw_food_category(spark, d), "copy_into_raw_food_category", schema)


@register("copy_into_raw_measure_unit", "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS id, 'unit ' || CAST(l_linenumber AS VARCHAR) AS name FROM lineitem")
def q_copy_into_raw_measure_unit(spark, d):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return _copy(spark, raw_measure_unit(spark, d), "copy_into_raw_measure_unit", schema)


FOOD_PORTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("fdc_id", T.LongType()), T.StructField("seq_num", T.IntegerType()),
    T.StructField("amount", T.DoubleType()), T.StructField("measure_unit_id", T.IntegerType()),
    T.StructField("portion_description", T.StringType()), T.StructField("modifier", T.StringType()),
    T.StructField("gram_weight", T.DoubleType()), T.StructField("data_points", T.IntegerType()), T.StructField("footnote", T.StringType()),
    T.StructField("min_year_acquired", T.IntegerType())])


@register("copy_into_raw_food_portion", an.RAW_FOOD_PORTION_FILE_SQL)
def q_copy_into_raw_food_portion(spark, d):
    return _copy(spark, an.raw_food_portion_file(spark, d), "copy_into_raw_food_portion", FOOD_PORTION_SCHEMA)
