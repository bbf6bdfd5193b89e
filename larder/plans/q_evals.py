"""Model-evaluation queries: arena rows, evaluation log, calorie-plan
results and model replies (all derived from the driver tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import textparse as tp
from larder.operators import evals as ev
from larder.plans import analogues as an
from larder.plans.registry import register
from larder.plans.q_vectors import MART_FOODS, mart
from larder.sources.tables import table

ARENA, LOG, RES = an.ARENA_SQL, an.EVAL_LOG_SQL, an.MODEL_RESULTS_SQL
MODELS = an.MODELS


def r6(c):
    return F.round(c, 6)


def np_round_sql(x, n):
    k = float(10 ** n)
    y = f"(({x}) * {k})"
    return (f"(CASE WHEN {y} - floor({y}) = 0.5 THEN (CASE WHEN fmod(floor({y}), 2) = 0 THEN floor({y}) ELSE floor({y}) + 1 END) "
            f"ELSE round({y}) END / {k})")


@register("model_leaderboard", f"""SELECT model_name, round(avg(latency), 6) AS avg_latency, round(avg(groundedness_score), 6) AS avg_groundedness,
  round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens,
  round(avg(output_tokens / NULLIF(input_tokens, 0)), 6) AS avg_token_ratio, CAST(COUNT(*) AS BIGINT) AS n FROM ({ARENA}) GROUP BY model_name""")
def q_model_leaderboard(spark, d):
    lb = ev.model_leaderboard(an.arena_results(spark, d))
    return lb.select("model_name", *[r6(F.col(c)).alias(c) for c in lb.columns if c.startswith("avg")], "n")


@register("eval_trend", f"SELECT execution_date, round(avg(score_accuracy), 6) AS avg_accuracy, round(avg(score_quality), 6) AS avg_quality FROM ({LOG}) GROUP BY 1")
def q_eval_trend(spark, d):
    t = ev.eval_trend(an.eval_log(spark, d))
    return t.select("execution_date", r6(F.col("avg_accuracy")).alias("avg_accuracy"), r6(F.col("avg_quality")).alias("avg_quality"))


@register("eval_latest_run", f"""SELECT run_id, round(avg(score_accuracy), 6) AS avg_accuracy, round(avg(score_quality), 6) AS avg_quality,
  CAST(COUNT(*) AS BIGINT) AS n_cases FROM ({LOG}) WHERE run_id = (SELECT arg_max(run_id, (execution_date, run_id)) FROM ({LOG})) GROUP BY run_id""")
def q_eval_latest_run(spark, d):
    t = ev.eval_latest_run(an.eval_log(spark, d))
    return t.select("run_id", r6(F.col("avg_accuracy")).alias("avg_accuracy"), r6(F.col("avg_quality")).alias("avg_quality"), "n_cases")


RES_F = f"SELECT * REPLACE (Success AND Error_Percent < 100 AS Success) FROM ({RES})"
_OK = "Success AND Error_Percent < 100"
MAE_SQL = f"""SELECT Model, CAST(SUM(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS VARCHAR) || '/' || CAST(COUNT(*) AS VARCHAR) AS Success_Rate,
  {np_round_sql(f'avg(CASE WHEN {_OK} THEN Error_kcal END)', 2)} AS MAE_kcal,
  {np_round_sql(f'avg(CASE WHEN {_OK} THEN Error_Percent END)', 2)} AS MAE_Percent,
  {np_round_sql(f'min(CASE WHEN {_OK} THEN Error_kcal END)', 2)} AS Min_Error_kcal,
  {np_round_sql(f'max(CASE WHEN {_OK} THEN Error_kcal END)', 2)} AS Max_Error_kcal,
  {np_round_sql(f'avg(CASE WHEN {_OK} THEN Processing_Time END)', 2)} AS Avg_Time_s,
  {np_round_sql('sum(Processing_Time)', 2)} AS Total_Time_s FROM ({RES_F}) GROUP BY Model"""


@register("mae_summary", MAE_SQL)
def q_mae_summary(spark, d):
    return ev.mae_summary(an.model_results(spark, d))


@register("success_failure_counts", f"""SELECT Model, CAST(SUM(CASE WHEN Success THEN 1 ELSE 0 END) AS BIGINT) AS successes,
  CAST(SUM(CASE WHEN NOT Success THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM ({RES_F}) GROUP BY Model""")
def q_success_failure_counts(spark, d):
    return ev.success_failure_counts(an.model_results(spark, d))


@register("overall_kpis", f"""SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(CASE WHEN Success THEN 1 ELSE 0 END) AS BIGINT) AS successes,
  round(COALESCE(SUM(CASE WHEN Success THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 0.0), 6) AS success_rate,
  round(COALESCE(avg(CASE WHEN Success THEN Error_Percent END), 0.0), 6) AS avg_error_pct,
  round(COALESCE(avg(Processing_Time), 0.0), 6) AS avg_time_s FROM ({RES_F})""")
def q_overall_kpis(spark, d):
    k = ev.overall_kpis(an.model_results(spark, d))
    return k.select("total", "successes", *[r6(F.col(c)).alias(c) for c in ("success_rate", "avg_error_pct", "avg_time_s")])


def _pivot_sql(expr, where=""):
    cols = ", ".join(f"round({expr.format(m=m)}, 6) AS \"{m}\"" for m in MODELS)
    return f"SELECT Profile, {cols} FROM ({RES_F}) {where} GROUP BY Profile"


@register("error_pivot", _pivot_sql("avg(CASE WHEN Model = '{m}' THEN Error_Percent END)", "WHERE Success"))
def q_error_pivot(spark, d):
    p = ev.error_pivot(an.model_results(spark, d), MODELS)
    return p.select("Profile", *[r6(F.col(f"`{m}`")).alias(m) for m in MODELS])


@register("success_matrix", _pivot_sql("CAST(max(CASE WHEN Model = '{m}' THEN CAST(Success AS INTEGER) END) AS DOUBLE)"))
def q_success_matrix(spark, d):
    p = ev.success_matrix(an.model_results(spark, d), MODELS)
    return p.select("Profile", *[r6(F.col(f"`{m}`").cast("double")).alias(m) for m in MODELS])


@register("generation_time_stats", f"""SELECT model_name, CAST(COUNT(latency) AS BIGINT) AS n, round(avg(latency), 6) AS avg, min(latency) AS min,
  max(latency) AS max, round(stddev_samp(latency), 6) AS stddev FROM ({ARENA}) GROUP BY model_name""")
def q_generation_time_stats(spark, d):
    g = ev.generation_time_stats(an.arena_results(spark, d), "latency", ["model_name"])
    return g.select("model_name", "n", r6(F.col("avg")).alias("avg"), "min", "max", r6(F.col("stddev")).alias("stddev"))


@register("box_stats", f"""SELECT Model, round(quantile_cont(Processing_Time, 0.0), 6) AS min, round(quantile_cont(Processing_Time, 0.25), 6) AS q1,
  round(quantile_cont(Processing_Time, 0.5), 6) AS median, round(quantile_cont(Processing_Time, 0.75), 6) AS q3,
  round(quantile_cont(Processing_Time, 1.0), 6) AS max FROM ({RES}) GROUP BY Model""")
def q_box_stats(spark, d):
    b = ev.box_stats(an.model_results(spark, d), ["Model"], "Processing_Time", "result_id")
    return b.select("Model", *[r6(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@register("latency_percentiles", f"""SELECT model_name, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS median,
  round(quantile_cont(latency, 0.95), 6) AS p95, round(1000.0 / avg(latency), 6) AS throughput FROM ({ARENA}) GROUP BY model_name""")
def q_latency_percentiles(spark, d):
    p = ev.latency_percentiles(an.arena_results(spark, d), ["model_name"], "latency", "row_id")
    return p.select("model_name", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p95", "throughput")])


_TT = f"""WITH g AS (SELECT COUNT(CASE WHEN Model = 'Llama 3.1 8B' THEN 1 END) AS n1, COUNT(CASE WHEN Model = 'Mistral 7B' THEN 1 END) AS n2,
  avg(CASE WHEN Model = 'Llama 3.1 8B' THEN Processing_Time END) AS m1, avg(CASE WHEN Model = 'Mistral 7B' THEN Processing_Time END) AS m2,
  var_samp(CASE WHEN Model = 'Llama 3.1 8B' THEN Processing_Time END) AS s1, var_samp(CASE WHEN Model = 'Mistral 7B' THEN Processing_Time END) AS s2,
  var_pop(CASE WHEN Model = 'Llama 3.1 8B' THEN Processing_Time END) AS p1, var_pop(CASE WHEN Model = 'Mistral 7B' THEN Processing_Time END) AS p2
  FROM ({RES}))
SELECT round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t_statistic,
  CAST(n1 + n2 - 2 AS BIGINT) AS dof, round(abs((m1 - m2) / sqrt((p1 + p2) / 2)), 6) AS cohens_d,
  CASE WHEN abs((m1 - m2) / sqrt((p1 + p2) / 2)) < 0.2 THEN 'Negligible' WHEN abs((m1 - m2) / sqrt((p1 + p2) / 2)) < 0.5 THEN 'Small'
       WHEN abs((m1 - m2) / sqrt((p1 + p2) / 2)) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect FROM g"""


@register("latency_ttest", _TT)
def q_latency_ttest(spark, d):
    s = ev.latency_ttest_stats(an.model_results(spark, d), "Model", "Processing_Time", "Llama 3.1 8B", "Mistral 7B")
    return s.select(r6(F.col("t_statistic")).alias("t_statistic"), "dof", r6(F.col("cohens_d")).alias("cohens_d"), "effect")


@register("latency_ttest_pvalue")
def q_latency_ttest_pvalue(spark, d):
    return ev.latency_ttest(an.model_results(spark, d), "Model", "Processing_Time", "Llama 3.1 8B", "Mistral 7B")


@register("best_worst_flags", f"""SELECT row_id, groundedness_score = (SELECT max(groundedness_score) FROM ({ARENA})) AS is_best_score,
  groundedness_score = (SELECT min(groundedness_score) FROM ({ARENA})) AS is_worst_score,
  latency = (SELECT min(latency) FROM ({ARENA})) AS is_fastest, latency = (SELECT max(latency) FROM ({ARENA})) AS is_slowest FROM ({ARENA})""")
def q_best_worst_flags(spark, d):
    f = ev.best_worst_flags(an.arena_results(spark, d), "groundedness_score", "latency")
    return f.select("row_id", "is_best_score", "is_worst_score", "is_fastest", "is_slowest")


_JUDGE_TXT = """'Coherence: ' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS VARCHAR) || '/10, Completeness: '
    || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS VARCHAR) || '/10' ||
    CASE WHEN event_type != 'error' THEN ', Accuracy: ' || CAST(user_id % 10 AS VARCHAR) || '/10' ELSE '' END"""
_JUDGE_ROWS = f"""SELECT event_type, CASE WHEN len(l) >= 3 THEN CAST(l[1] AS INTEGER) END AS c1, CASE WHEN len(l) >= 3 THEN CAST(l[2] AS INTEGER) END AS c2,
  CASE WHEN len(l) >= 3 THEN CAST(l[3] AS INTEGER) END AS c3 FROM (SELECT event_type, regexp_extract_all({_JUDGE_TXT}, '(\\d+)/10', 1) AS l FROM events)"""


@register("overall_quality", f"""SELECT {an._case_sql('event_type', an.MODEL_BY_EVENT)} AS Model,
  round((avg(c1) + avg(c2) + avg(c3)) / 3, 6) AS overall_quality FROM ({_JUDGE_ROWS}) GROUP BY 1""")
def q_overall_quality(spark, d):
    from larder.operators import vectors as vx
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.concat(F.lit("Coherence: "), (k % 10).cast("string"), F.lit("/10, Completeness: "), (k % 7).cast("string"),
                 F.lit("/10"), F.when(F.col("event_type") != "error",
                                      F.concat(F.lit(", Accuracy: "), (F.col("user_id") % 10).cast("string"), F.lit("/10")))
                 .otherwise(F.lit("")))
    s = e.select(an._case(F.col("event_type"), an.MODEL_BY_EVENT).alias("Model"), *vx.judge_scores(t))
    g = s.groupBy("Model").agg(((F.avg("coherence") + F.avg("completeness") + F.avg("accuracy")) / 3).alias("q"))
    return g.select("Model", r6(F.col("q")).alias("overall_quality"))


@register("factual_accuracy_stats", f"""WITH f AS (SELECT fdc_id, food_name, category, calories, string_split(food_name, ' ')[-1] AS word FROM ({MART_FOODS})),
t AS (SELECT word, avg(calories) AS truth FROM (SELECT unnest(list_distinct(string_split(lower(food_name), ' '))) AS word, calories FROM f) GROUP BY word),
a AS (SELECT f.category, CASE WHEN f.fdc_id % 11 <> 0 THEN greatest(0.0, 1.0 - abs(CAST(trunc(f.calories) AS BIGINT) + 7 - t.truth) / t.truth) END AS accuracy FROM f JOIN t ON f.word = t.word)
SELECT category, round(avg(accuracy), 6) AS mean_accuracy, round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy
FROM a GROUP BY category""")
def q_factual_accuracy_stats(spark, d):
    from larder.plans.q_vectors import factual_accuracy_rows
    acc = factual_accuracy_rows(spark, d)
    g = acc.groupBy("category").agg(F.avg("accuracy").alias("a"), F.min("accuracy").alias("mn"), F.max("accuracy").alias("mx"))
    return g.select("category", r6(F.col("a")).alias("mean_accuracy"), r6(F.col("mn")).alias("min_accuracy"),
                    r6(F.col("mx")).alias("max_accuracy"))


def responses(spark, d):
    """Plan replies assembled from lineitem columns in five layouts."""
    li = table(spark, d, "lineitem")
    a = (F.col("l_quantity") * 20).cast("long").cast("string")
    t1 = (F.col("l_extendedprice") / 30).cast("long").cast("string")
    t2 = (F.col("l_extendedprice") / 25).cast("long").cast("string")
    t3 = (F.col("l_extendedprice") / 20).cast("long").cast("string")
    ln = F.col("l_linenumber")
    txt = (F.when(ln <= 2, F.concat(F.lit("**Meal Plan 1**\nBreakfast "), a, F.lit(" kcal\nTotal: "), t1, F.lit(" kcal\n"),
                                    F.lit("**meal plan 2**\nTotal: "), t2, F.lit(" kcal\nMEAL PLAN 3\nTotal "), t3, F.lit("kcal")))
           .when(ln == 3, F.concat(F.lit("Meal Plan 1: total "), t1, F.lit(" kcal\nMeal Plan 2: no numbers here\nMeal Plan 3: "), a, F.lit(" kcal")))
           .when(ln == 4, F.concat(F.lit("Here is the plan. Total Calories: "), t2, F.lit(" kcal overall.")))
           .when(ln == 5, F.lit("I cannot help with that."))
           .otherwise(F.concat(F.lit("MEAL PLAN 1 Total Calories: "), t3, F.lit(" KCAL"))))
    target = (F.lit(1500) + (F.col("l_orderkey") % 10) * 100).cast("double")
    return li.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("response_id"),
                     txt.alias("response"), target.alias("target"))


_RESP_SQL = """SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS response_id, CAST(1500 + (l_orderkey % 10) * 100 AS DOUBLE) AS target,
  CASE WHEN l_linenumber <= 2 THEN '**Meal Plan 1**' || chr(10) || 'Breakfast ' || a || ' kcal' || chr(10) || 'Total: ' || t1 || ' kcal' || chr(10)
         || '**meal plan 2**' || chr(10) || 'Total: ' || t2 || ' kcal' || chr(10) || 'MEAL PLAN 3' || chr(10) || 'Total ' || t3 || 'kcal'
       WHEN l_linenumber = 3 THEN 'Meal Plan 1: total ' || t1 || ' kcal' || chr(10) || 'Meal Plan 2: no numbers here' || chr(10) || 'Meal Plan 3: ' || a || ' kcal'
       WHEN l_linenumber = 4 THEN 'Here is the plan. Total Calories: ' || t2 || ' kcal overall.'
       WHEN l_linenumber = 5 THEN 'I cannot help with that.'
       ELSE 'MEAL PLAN 1 Total Calories: ' || t3 || ' KCAL' END AS response
FROM (SELECT *, CAST(CAST(trunc(l_quantity * 20) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(trunc(l_extendedprice / 30) AS BIGINT) AS VARCHAR) AS t1,
  CAST(CAST(trunc(l_extendedprice / 25) AS BIGINT) AS VARCHAR) AS t2, CAST(CAST(trunc(l_extendedprice / 20) AS BIGINT) AS VARCHAR) AS t3 FROM lineitem)"""
_SECTION_VAL = """CASE WHEN len(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*kcal', 1)) > 0 THEN COALESCE(list_max(list_filter(
  list_transform(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*kcal', 1), lambda x: CAST(x AS DOUBLE)), lambda v: v >= 1000 AND v <= 4000)), 0.0) END"""
_CALS_SQL = f"""SELECT response_id, target, list_concat(CASE WHEN len(secs) > 1 THEN list_filter(list_transform(secs[2:4], lambda s: {_SECTION_VAL}), lambda x: x IS NOT NULL)
  ELSE list_filter(list_transform(regexp_extract_all(response, '(?i)Total Calories?:?\\s*(\\d+(?:\\.\\d+)?)\\s*kcal', 1), lambda x: CAST(x AS DOUBLE)),
    lambda v: v >= 1000 AND v <= 4000) END, [0.0, 0.0, 0.0])[1:3] AS cals
FROM (SELECT *, regexp_split_to_array(response, '(?i)\\*\\*Meal Plan \\d+\\*\\*|Meal Plan \\d+:|MEAL PLAN \\d+') AS secs FROM ({_RESP_SQL}))"""


@register("extract_plan_calories", f"SELECT response_id, cals[1] AS plan_1, cals[2] AS plan_2, cals[3] AS plan_3 FROM ({_CALS_SQL})")
def q_extract_plan_calories(spark, d):
    r = responses(spark, d).withColumn("c", tp.extract_plan_calories(F.col("response")))
    return r.select("response_id", F.col("c")[0].alias("plan_1"), F.col("c")[1].alias("plan_2"), F.col("c")[2].alias("plan_3"))


@register("calorie_error", f"""SELECT response_id, round(CASE WHEN n > 0 THEN m ELSE 0.0 END, 6) AS actual_calories,
  round(CASE WHEN n > 0 THEN abs(m - target) ELSE target END, 6) AS error_kcal,
  round(CASE WHEN n > 0 THEN abs(m - target) / target * 100 ELSE 100.0 END, 6) AS error_pct,
  (CASE WHEN n > 0 THEN abs(m - target) / target * 100 ELSE 100.0 END) < 100 AS success
FROM (SELECT response_id, target, len(list_filter(cals, lambda c: c > 0)) AS n,
  list_sum(list_filter(cals, lambda c: c > 0)) / len(list_filter(cals, lambda c: c > 0)) AS m FROM ({_CALS_SQL}))""")
def q_calorie_error(spark, d):
    r = tp.with_calorie_error(responses(spark, d).withColumn("c", tp.extract_plan_calories(F.col("response"))), "c", "target")
    return r.select("response_id", r6(F.col("e.actual_calories")).alias("actual_calories"),
                    r6(F.col("e.error_kcal")).alias("error_kcal"), r6(F.col("e.error_pct")).alias("error_pct"),
                    F.col("e.success").alias("success"))


# Plans of the router: the expected action first for most cases, an empty plan,
# no plan, and text that is no array.
INTENT_CASES_SQL = f"""SELECT id, model_version AS category, CASE WHEN id % 3 = 0 THEN 'high' ELSE 'low' END AS complexity, expected_intent,
  CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN id % 7 < 3 OR id % 11 = 0 THEN 'unknown'
    WHEN id % 5 = 0 THEN 'inventory_update' ELSE expected_intent END AS actual_intent FROM ({LOG})"""


def intent_cases(spark, d):
    lg, i = an.eval_log(spark, d), F.col("id")
    first = F.when(i % 5 == 0, F.lit("inventory_update")).otherwise(F.col("expected_intent"))
    steps = F.array(F.struct(first.alias("action"), F.lit("q").alias("query")), F.struct(F.lit("general_chat").alias("action"), F.lit("").alias("query")))
    plan = (F.when(i % 11 == 0, F.lit("no plan")).when(i % 7 == 0, F.lit("[]")).when(i % 7 == 1, F.lit(None).cast("string"))
            .when(i % 7 == 2, F.lit('[{"query": "x"}]')).otherwise(F.to_json(steps)))
    return lg.select("id", F.col("model_version").alias("category"), F.when(i % 3 == 0, F.lit("high")).otherwise(F.lit("low")).alias("complexity"),
                     "expected_intent", ev.actual_intent(plan, F.col("error")).alias("actual_intent"))


@register("actual_intent", f"SELECT id, expected_intent, actual_intent FROM ({INTENT_CASES_SQL})")
def q_actual_intent(spark, d):
    return intent_cases(spark, d).select("id", "expected_intent", "actual_intent")


@register("intent_accuracy", f"""SELECT category, complexity, round(avg(CASE WHEN actual_intent = expected_intent THEN 1.0 ELSE 0.0 END), 6) AS intent_accuracy,
  CAST(COUNT(*) AS BIGINT) AS n_cases FROM ({INTENT_CASES_SQL}) GROUP BY ALL""")
def q_intent_accuracy(spark, d):
    return ev.intent_accuracy(intent_cases(spark, d)).withColumn("intent_accuracy", r6(F.col("intent_accuracy")))


@register("case_result_join", f"""SELECT l.doc_id AS id, CASE l.quality WHEN 0 THEN 'general_chat' ELSE 'meal_retrieval' END AS expected_intent,
  r.actual_intent, r.actual_intent = (CASE l.quality WHEN 0 THEN 'general_chat' ELSE 'meal_retrieval' END) AS correct
FROM labels l JOIN (SELECT id, actual_intent FROM ({LOG})) r ON l.doc_id = r.id""")
def q_case_result_join(spark, d):
    cases = table(spark, d, "labels").select(F.col("doc_id").alias("id"),
                                             an._case(F.col("quality"), an.INTENT_BY_QUALITY).alias("expected_intent"))
    res = an.eval_log(spark, d).select("id", "actual_intent")
    j = cases.join(res, "id")
    return j.withColumn("correct", F.col("actual_intent") == F.col("expected_intent"))


def judge_replies(spark, d):
    lab = table(spark, d, "labels")
    k = F.col("doc_id") % 4
    q, t = F.col("quality").cast("string"), (F.col("toxic") + 3).cast("string")
    txt = (F.when(k == 0, F.concat(F.lit('```json\n{"accuracy": '), q, F.lit(', "quality": '), t, F.lit(', "reasoning": "fine", "score": '), t, F.lit("}\n```")))
           .when(k == 1, F.concat(F.lit('Result: {"accuracy": '), q, F.lit("}")))
           .when(k == 2, F.concat(F.lit('```\n{"quality": '), t, F.lit("}\n```")))
           .otherwise(F.concat(F.lit('not json "score": '), t, F.lit(" here"))))
    return lab.select("doc_id", txt.alias("content"))


_JR = """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN '```json' || chr(10) || '{"accuracy": ' || CAST(quality AS VARCHAR) || ', "quality": ' || CAST(toxic + 3 AS VARCHAR) || ', "reasoning": "fine", "score": ' || CAST(toxic + 3 AS VARCHAR) || '}' || chr(10) || '```'
  WHEN 1 THEN 'Result: {"accuracy": ' || CAST(quality AS VARCHAR) || '}'
  WHEN 2 THEN '```' || chr(10) || '{"quality": ' || CAST(toxic + 3 AS VARCHAR) || '}' || chr(10) || '```'
  ELSE 'not json "score": ' || CAST(toxic + 3 AS VARCHAR) || ' here' END AS content FROM labels"""
_BODY = """regexp_replace(CASE WHEN contains(content, '```json') THEN split_part(split_part(content, '```json', 2), '```', 1)
  WHEN contains(content, '```') THEN split_part(content, '```', 2) ELSE content END, '^\\s+|\\s+$', '', 'g')"""


@register("parse_judge_json", f"""SELECT doc_id, CASE WHEN ok THEN COALESCE(TRY_CAST(json_extract(body, '$.accuracy') AS DOUBLE), 0.0) ELSE 0.0 END AS accuracy,
  CASE WHEN ok THEN COALESCE(TRY_CAST(json_extract(body, '$.quality') AS DOUBLE), 0.0) ELSE 0.0 END AS quality,
  CASE WHEN ok THEN COALESCE(json_extract_string(body, '$.reasoning'), 'No reasoning provided') ELSE 'Judge Error' END AS reasoning,
  CASE WHEN ok THEN COALESCE(TRY_CAST(json_extract(body, '$.score') AS INTEGER), 0)
       ELSE COALESCE(TRY_CAST(NULLIF(regexp_extract(body, '"score":\\s*(\\d+)', 1), '') AS INTEGER), 0) END AS arena_score
FROM (SELECT doc_id, body, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS ok FROM (SELECT doc_id, {_BODY} AS body FROM ({_JR})))""")
def q_parse_judge_json(spark, d):
    r = judge_replies(spark, d)
    j = tp.parse_judge_json(F.col("content"))
    return r.select("doc_id", j["accuracy"].alias("accuracy"), j["quality"].alias("quality"), j["reasoning"].alias("reasoning"),
                    F.coalesce(tp.arena_score(F.col("content")), F.lit(0)).alias("arena_score"))


def _raw_texts(spark, d):
    c = table(spark, d, "conversations")
    k = F.col("turn") % 4
    raw = (F.when(k == 0, F.concat(F.lit('  [{"turn": '), F.col("turn").cast("string"), F.lit("}]  ")))
           .when(k == 1, F.concat(F.lit("Plan: ["), F.col("conv_id").cast("string"), F.lit(", 2, 3] done")))
           .when(k == 2, F.concat(F.lit('Answer {"conv": '), F.col("conv_id").cast("string"), F.lit("} end")))
           .otherwise(F.col("text")))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), raw.alias("raw"))


_RAW_SQL = """SELECT conv_id * 100 + turn AS message_id, CASE turn % 4 WHEN 0 THEN '  [{"turn": ' || CAST(turn AS VARCHAR) || '}]  '
  WHEN 1 THEN 'Plan: [' || CAST(conv_id AS VARCHAR) || ', 2, 3] done' WHEN 2 THEN 'Answer {"conv": ' || CAST(conv_id AS VARCHAR) || '} end'
  ELSE text END AS raw FROM conversations"""


@register("extract_json_from_text", f"""SELECT message_id, CASE WHEN json_valid(c) THEN 'whole' WHEN json_valid(NULLIF(regexp_extract(c, '(?s)\\[.*\\]', 0), '')) THEN 'list'
  WHEN json_valid(NULLIF(regexp_extract(c, '(?s)\\{{.*\\}}', 0), '')) THEN 'object' ELSE 'none' END AS stage
FROM (SELECT message_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS c FROM ({_RAW_SQL}))""")
def q_extract_json_from_text(spark, d):
    r = _raw_texts(spark, d)
    return r.select("message_id", tp.extract_json_from_text(F.col("raw"))["stage"].alias("stage"))


def _repair_inputs(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    txt = (F.when(k == 0, F.concat(F.lit('Sure: {"meal_name": "'), F.col("p_name"), F.lit('", "calories": '), F.col("p_size").cast("string"), F.lit(",} ok")))
           .when(k == 1, F.concat(F.lit('{"meal_name": "'), F.col("p_name"), F.lit('", // the name\n "calories": 3}')))
           .when(k == 2, F.lit("[1, 2]"))
           .otherwise(F.concat(F.lit("no json for "), F.col("p_name"))))
    return p.select(F.col("p_partkey").alias("reply_id"), txt.alias("content"))


_REPAIR_SQL = """SELECT p_partkey AS reply_id, CASE p_partkey % 4 WHEN 0 THEN 'Sure: {"meal_name": "' || p_name || '", "calories": ' || CAST(p_size AS VARCHAR) || ',} ok'
  WHEN 1 THEN '{"meal_name": "' || p_name || '", // the name' || chr(10) || ' "calories": 3}' WHEN 2 THEN '[1, 2]'
  ELSE 'no json for ' || p_name END AS content FROM part"""


@register("repair_json_text", f"""WITH a AS (SELECT reply_id, regexp_replace(COALESCE(NULLIF(regexp_extract(content, '(?s)\\{{.*\\}}', 0), ''), content), ',(\\s*[}}\\]])', '\\1', 'g') AS c FROM ({_REPAIR_SQL})),
b AS (SELECT reply_id, CASE WHEN json_valid(c) THEN c ELSE regexp_replace(regexp_replace(c, '//.*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') END AS c2 FROM a)
SELECT reply_id, ok, CASE WHEN ok THEN json_extract_string(c2, '$.meal_name') END AS meal_name FROM (
  SELECT reply_id, c2, CASE WHEN json_valid(c2) THEN json_type(c2) = 'OBJECT' ELSE false END AS ok FROM b)""")
def q_repair_json_text(spark, d):
    r = _repair_inputs(spark, d).withColumn("x", tp.repair_json_text(F.col("content")))
    return r.select("reply_id", F.col("x.ok").alias("ok"),
                    F.try_variant_get(F.col("x.value"), "$.meal_name", "string").alias("meal_name"))


def _tool_texts(spark, d):
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    q = F.concat(F.lit("q"), (F.col("conv_id") % 5).cast("string"))
    txt = F.concat(F.lit('Searching. {"tool": "search_foods", "query": "'), q, F.lit('"} and {"tool": "other", "query": "x"} '),
                   F.lit('{"tool": "search_foods", "query": "t'), F.col("turn").cast("string"), F.lit('"} {"tool": "search_foods", "query": "bad'))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), txt.alias("content"))


@register("extract_tool_calls", """SELECT message_id, CAST(pos - 1 AS INTEGER) AS call_pos, json_extract_string(x, '$.query') AS query FROM (
  SELECT message_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (
    SELECT conv_id * 100 + turn AS message_id, regexp_extract_all('Searching. {"tool": "search_foods", "query": "q' || CAST(conv_id % 5 AS VARCHAR)
      || '"} and {"tool": "other", "query": "x"} {"tool": "search_foods", "query": "t' || CAST(turn AS VARCHAR) || '"} {"tool": "search_foods", "query": "bad',
      '(\\{[^{}]*\\})', 1) AS l FROM conversations WHERE role = 'assistant'))
WHERE json_valid(x) AND json_extract_string(x, '$.tool') = 'search_foods'""")
def q_extract_tool_calls(spark, d):
    t = _tool_texts(spark, d)
    x = t.select("message_id", F.posexplode(tp.tool_call_candidates(F.col("content"))).alias("call_pos", "c"))
    return x.where(F.col("c.tool") == "search_foods").select("message_id", "call_pos", F.col("c.query").alias("query"))


def _blocks(spark, d):
    c = table(spark, d, "conversations")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    js = F.concat(F.lit('[{"thinking": "plan it"}, {"content": [{"text": "Turn '), turn, F.lit('"}, "plain '), conv,
                  F.lit('"]}, {"tool_use": {"name": "search"}}, {"text": "```json\\n{\\"a\\": '), turn, F.lit('}\\n```"}]'))
    blocks = F.when(F.col("turn") % 3 == 0, F.lit("[]")).otherwise(js)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), blocks.alias("blocks"))


@register("agent_text_blocks", """SELECT message_id, CASE WHEN turn % 3 = 0 THEN 'No clear response found'
  ELSE 'Turn ' || CAST(turn AS VARCHAR) || chr(10) || chr(10) || 'plain ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || '{"a": ' || CAST(turn AS VARCHAR) || '}' END AS answer
FROM (SELECT conv_id * 100 + turn AS message_id, conv_id, turn FROM conversations)""")
def q_agent_text_blocks(spark, d):
    b = _blocks(spark, d)
    return b.select("message_id", tp.agent_text_blocks(F.col("blocks")).alias("answer"))


_GT_SQL = f"""SELECT fdc_id, CASE WHEN abs(calories * (1 + ((fdc_id % 5) - 2) * 0.1) - calories) <= 0.2 * calories
  AND abs(protein * (1 + ((fdc_id % 3) - 1) * 0.25) - protein) <= 0.2 * protein THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict FROM ({MART_FOODS})"""


@register("ground_truth_verdict", _GT_SQL)
def q_ground_truth_verdict(spark, d):
    mt = mart(spark, d).select("fdc_id", "calories", "protein")
    g = mt.select("fdc_id", "calories", "protein",
                  (F.col("calories") * (1 + ((F.col("fdc_id") % 5) - 2) * 0.1)).alias("gen_calories"),
                  (F.col("protein") * (1 + ((F.col("fdc_id") % 3) - 1) * 0.25)).alias("gen_protein"))
    return g.select("fdc_id", ev.ground_truth_verdict(g, [("gen_calories", "calories"), ("gen_protein", "protein")]).alias("verdict"))


PAPER_SQL = "(VALUES " + ", ".join(f"('{m}', {v}::DOUBLE)" for m, v in ev.PAPER_MAE) + ") AS p(Model, Paper_MAE_Percent)"


@register("paper_constant_join", f"SELECT s.Model, s.MAE_Percent, p.Paper_MAE_Percent FROM ({MAE_SQL}) s LEFT JOIN {PAPER_SQL} USING (Model)")
def q_paper_constant_join(spark, d):
    j = ev.paper_constant_join(ev.mae_summary(an.model_results(spark, d)), spark)
    return j.select("Model", "MAE_Percent", "Paper_MAE_Percent")


@register("paper_difference", f"""SELECT s.Model, s.MAE_Percent, p.Paper_MAE_Percent, round(s.MAE_Percent - p.Paper_MAE_Percent, 6) AS Difference
FROM ({MAE_SQL}) s JOIN {PAPER_SQL} USING (Model)""")
def q_paper_difference(spark, d):
    j = ev.paper_constant_join(ev.mae_summary(an.model_results(spark, d)), spark)
    return j.where(F.col("Paper_MAE_Percent").isNotNull()).select(
        "Model", "MAE_Percent", "Paper_MAE_Percent", r6(F.col("Difference")).alias("Difference"))


@register("smallest_error", f"""SELECT result_id, Model, Error_kcal FROM ({RES_F}) WHERE Success ORDER BY Error_kcal, result_id LIMIT 1""")
def q_smallest_error(spark, d):
    r = ev.mark_failures(an.model_results(spark, d)).where(F.col("Success"))
    return r.orderBy("Error_kcal", "result_id").limit(1).select("result_id", "Model", "Error_kcal")


@register("best_model", f"SELECT arg_min(Model, (MAE_Percent, Model)) AS Model, min(MAE_Percent) AS MAE_Percent FROM ({MAE_SQL}) WHERE MAE_Percent IS NOT NULL")
def q_best_model(spark, d):
    s = ev.mae_summary(an.model_results(spark, d)).where(F.col("MAE_Percent").isNotNull())
    return s.agg(F.min_by("Model", F.struct("MAE_Percent", "Model")).alias("Model"), F.min("MAE_Percent").alias("MAE_Percent"))


@register("fastest_models", f"SELECT Model, Avg_Time_s FROM ({MAE_SQL}) ORDER BY Avg_Time_s NULLS LAST, Model LIMIT 3")
def q_fastest_models(spark, d):
    s = ev.mae_summary(an.model_results(spark, d))
    return s.orderBy(F.col("Avg_Time_s").asc_nulls_last(), "Model").limit(3).select("Model", "Avg_Time_s")


@register("filter_isin_multi", f"""SELECT result_id, Model, Profile FROM ({RES_F}) WHERE Model IN ('Llama 3.1 8B', 'Mistral 7B')
  AND Profile IN ('P1', 'P3') AND Success""")
def q_filter_isin_multi(spark, d):
    r = ev.mark_failures(an.model_results(spark, d))
    return r.where(F.col("Model").isin("Llama 3.1 8B", "Mistral 7B") & F.col("Profile").isin("P1", "P3") & F.col("Success")) \
        .select("result_id", "Model", "Profile")


@register("drop_null_rows", f"SELECT Model, MAE_Percent FROM ({MAE_SQL}) WHERE MAE_Percent IS NOT NULL")
def q_drop_null_rows(spark, d):
    return ev.mae_summary(an.model_results(spark, d)).dropna(subset=["MAE_Percent"]).select("Model", "MAE_Percent")


@register("model_rank", f"""SELECT Model, MAE_Percent, CAST(ROW_NUMBER() OVER (ORDER BY MAE_Percent, Model) AS INTEGER) AS rank FROM ({MAE_SQL})
  WHERE MAE_Percent IS NOT NULL QUALIFY rank <= 3""")
def q_model_rank(spark, d):
    return ev.model_rank(ev.mae_summary(an.model_results(spark, d))).select("Model", "MAE_Percent", "rank")
