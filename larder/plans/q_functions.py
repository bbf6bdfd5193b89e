"""Scalar function families and small relational keys
(O3, E3), each exercised over a driver table with several columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.mathfn import pyround, pyround_sql
from larder.plans import analogues as an
from larder.plans.registry import register
from larder.sources.tables import table


@register("fn_string", """SELECT p_partkey, lower(p_name) AS lower_name, upper(p_brand) AS upper_brand, trim('  ' || p_type || ' ') AS trimmed,
  p_name || ' / ' || p_type AS labelled, CAST(p_size AS VARCHAR) AS size_text, substr(p_name, 1, 3) AS first3,
  replace(p_brand, 'Brand#', 'B') AS short_brand, array_to_string(string_split(p_name, ' '), '_') AS joined,
  p_name ILIKE '%RED%' AS is_red, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title_type FROM part""")
def q_fn_string(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.lower("p_name").alias("lower_name"), F.upper("p_brand").alias("upper_brand"),
                    F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
                    F.concat(F.col("p_name"), F.lit(" / "), F.col("p_type")).alias("labelled"),
                    F.col("p_size").cast("string").alias("size_text"), F.substring("p_name", 1, 3).alias("first3"),
                    F.regexp_replace("p_brand", "Brand#", "B").alias("short_brand"),
                    F.array_join(F.split("p_name", " "), "_").alias("joined"),
                    F.col("p_name").ilike("%RED%").alias("is_red"), F.initcap("p_type").alias("title_type"))


@register("fn_regex", """SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host,
  CAST(len(regexp_extract_all(html, '<p[ >]', 0)) AS BIGINT) AS n_paragraphs, regexp_matches(url, '(?i)example') AS is_example,
  regexp_full_match(CAST(page_id AS VARCHAR), '[0-9]+') AS id_digits, regexp_replace(url, '[?#].*$', '') AS url_no_query,
  CAST(len(regexp_split_to_array(url, '/')) AS BIGINT) AS n_url_parts FROM pages""")
def q_fn_regex(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"),
                    F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"),
                    F.size(F.regexp_extract_all("html", F.lit(r"<p[ >]"), 0)).cast("long").alias("n_paragraphs"),
                    F.col("url").rlike("(?i)example").alias("is_example"),
                    F.col("page_id").cast("string").rlike(r"\A[0-9]+\z").alias("id_digits"),
                    F.regexp_replace("url", r"[?#].*$", "").alias("url_no_query"),
                    F.size(F.split("url", "/")).cast("long").alias("n_url_parts"))


@register("fn_date", f"""SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(o_orderdate AS DATE) + 6 AS plan_end,
  CAST(o_orderdate AS DATE) - 28 AS four_weeks_before, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '{an.AS_OF}') AS INTEGER) AS days_to_as_of,
  strftime(o_orderdate, '%A') AS day_name, strftime(o_orderdate, '%B %d, %Y') AS long_date, strftime(o_orderdate, '%b %d') AS short_date FROM orders""")
def q_fn_date(spark, d):
    o = table(spark, d, "orders")
    dt = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).cast("date").alias("week_start"),
                    F.date_add(dt, 6).alias("plan_end"), F.date_sub(dt, 28).alias("four_weeks_before"),
                    F.datediff(F.lit(an.AS_OF).cast("date"), dt).alias("days_to_as_of"),
                    F.date_format("o_orderdate", "EEEE").alias("day_name"),
                    F.date_format("o_orderdate", "MMMM dd, yyyy").alias("long_date"),
                    F.date_format("o_orderdate", "MMM dd").alias("short_date"))


@register("fn_math", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {pyround_sql('l_extendedprice / 3', 2)} AS price_third,
  CAST(trunc(l_extendedprice / 7) AS INTEGER) AS price_int, abs(l_quantity - 25) AS dist25, CAST(floor(l_quantity / 12) AS BIGINT) AS dozens,
  least(l_quantity * 2, 60.0) AS capped, greatest(l_discount, 0.05) AS floor_disc, round(sqrt(l_quantity), 6) AS root_qty FROM lineitem""")
def q_fn_math(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pyround(F.col("l_extendedprice") / 3, 2).alias("price_third"),
                     (F.col("l_extendedprice") / 7).cast("int").alias("price_int"), F.abs(F.col("l_quantity") - 25).alias("dist25"),
                     F.floor(F.col("l_quantity") / 12).cast("long").alias("dozens"),
                     F.least(F.col("l_quantity") * 2, F.lit(60.0)).alias("capped"),
                     F.greatest(F.col("l_discount"), F.lit(0.05)).alias("floor_disc"), F.round(F.sqrt("l_quantity"), 6).alias("root_qty"))


@register("fn_null", f"""SELECT feedback_id, COALESCE(timing, 'none') AS timing_or_none, NULLIF(intensity, 3) AS intensity_not3,
  CASE WHEN timing IS NULL OR timing = '' THEN 'Other' ELSE timing END AS timing_or_other, timing IS NULL AS no_timing FROM ({an.FEEDBACK_SQL})""")
def q_fn_null(spark, d):
    f = an.feedback(spark, d)
    return f.select("feedback_id", F.coalesce("timing", F.lit("none")).alias("timing_or_none"),
                    F.nullif(F.col("intensity"), F.lit(3)).alias("intensity_not3"),
                    F.when(F.col("timing").isNull() | (F.col("timing") == ""), F.lit("Other")).otherwise(F.col("timing")).alias("timing_or_other"),
                    F.col("timing").isNull().alias("no_timing"))


@register("fn_array", """SELECT p_partkey, CAST(len(w) AS BIGINT) AS n_words, list_contains(w, 'red') AS has_red, w[1] AS first_word,
  array_to_string(w[1:1], ' ') AS first_slice, CAST(len(list_distinct(flatten([w, w]))) AS BIGINT) AS n_distinct,
  CAST(len(list_filter(w, lambda x: len(x) > 3)) AS BIGINT) AS n_long FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def q_fn_array(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return p.select("p_partkey", F.size("w").cast("long").alias("n_words"), F.array_contains("w", "red").alias("has_red"),
                    F.col("w")[0].alias("first_word"), F.array_join(F.slice("w", 1, 1), " ").alias("first_slice"),
                    F.size(F.array_distinct(F.flatten(F.array("w", "w")))).cast("long").alias("n_distinct"),
                    F.size(F.filter("w", lambda x: F.length(x) > 3)).cast("long").alias("n_long"))


@register("fn_map", """SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, NULL::VARCHAR AS missing, 2::BIGINT AS n_keys,
  'priority,status' AS keys FROM orders""")
def q_fn_map(spark, d):
    o = table(spark, d, "orders")
    m = F.map_from_entries(F.array(F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("v")),
                                   F.struct(F.lit("priority").alias("k"), F.col("o_orderpriority").alias("v"))))
    return o.select("o_orderkey", F.element_at(m, F.lit("status")).alias("status"), m["priority"].alias("priority"),
                    F.try_element_at(m, F.lit("nope")).alias("missing"), F.size(m).cast("long").alias("n_keys"),
                    F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


@register("fn_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k,
  CAST(json_extract(props, '$.z') AS INTEGER) AS z, json_extract_string(props, '$.k') AS k_text,
  CAST(json_extract(props, '$.k') AS DOUBLE) * value AS scaled FROM events""")
def q_fn_json(spark, d):
    e = table(spark, d, "events")
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    return e.select("event_id", k.alias("k"), F.try_variant_get(v, "$.k", "variant").isNotNull().alias("has_k"),
                    F.try_variant_get(v, "$.z", "int").alias("z"), F.get_json_object("props", "$.k").alias("k_text"),
                    (F.try_variant_get(v, "$.k", "double") * F.col("value")).alias("scaled"))


@register("fn_hash", "SELECT c_custkey, sha256(c_name) AS name_hash, sha256(c_name || ':' || c_mktsegment) AS pair_hash FROM customer")
def q_fn_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.sha2("c_name", 256).alias("name_hash"),
                    F.sha2(F.concat_ws(":", "c_name", "c_mktsegment"), 256).alias("pair_hash"))


@register("fn_cast", """SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS name_number, TRY_CAST(c_mktsegment AS DOUBLE) AS segment_number,
  CAST(c_nationkey AS BIGINT) AS nation_long, CAST(c_custkey AS VARCHAR) AS key_text FROM customer""")
def q_fn_cast(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.substring("c_name", 10, 100).try_cast("bigint").alias("name_number"),
                    F.col("c_mktsegment").try_cast("double").alias("segment_number"),
                    F.col("c_nationkey").cast("bigint").alias("nation_long"), F.col("c_custkey").cast("string").alias("key_text"))


@register("order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def q_order_limit(spark, d):
    # O3: top-n is the feature; planned as TakeOrderedAndProject (n rows per task)
    return table(spark, d, "events").orderBy(F.col("value").desc(), "event_id").limit(10).select("event_id", "value")


@register("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def q_distinct_rows(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()
