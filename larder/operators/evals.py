"""Model-evaluation analytics (A10-A18, A21, A22, A25, A29, A33, A34, D18,
D28, D38, J13, J19, O4-O6, P18, P21, W15). Aggregates are grouped by
model/profile/run; global extremes come from one aggregate used as a scalar
subquery rather than an unpartitioned window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.common import exact_quantiles

# Published calorie MAE (%) quoted by the reference.
PAPER_MAE = [("Llama 3.1 8B", 1.55), ("GPT-3.5-turbo", 3.68)]
# Effect-size labels by |d| thresholds.
EFFECT_LABELS = [(0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium")]


def np_round(c: Column, n: int) -> Column:
    """pandas/numpy ``round``: half-even on the scaled double (rint)."""
    k = float(10 ** n)
    return F.rint(c * k) / k


def model_leaderboard(arena: DataFrame) -> DataFrame:
    """A10: per model mean latency, score, tokens and the mean of per-row
    output/input ratios (K20)."""
    return arena.groupBy("model_name").agg(
        F.avg("latency").alias("avg_latency"), F.avg("groundedness_score").alias("avg_groundedness"),
        F.avg("input_tokens").alias("avg_input_tokens"), F.avg("output_tokens").alias("avg_output_tokens"),
        F.avg(F.try_divide(F.col("output_tokens"), F.col("input_tokens"))).alias("avg_token_ratio"),
        F.count(F.lit(1)).cast("long").alias("n"))


def eval_trend(log: DataFrame) -> DataFrame:
    """Per execution date mean accuracy and quality."""
    return log.groupBy("execution_date").agg(F.avg("score_accuracy").alias("avg_accuracy"),
                                             F.avg("score_quality").alias("avg_quality"))


def eval_latest_run(log: DataFrame) -> DataFrame:
    """The newest run (latest date, then run id) and its means."""
    latest = log.agg(F.max_by("run_id", F.struct("execution_date", "run_id"))).scalar()
    return (log.where(F.col("run_id") == latest).groupBy("run_id")
            .agg(F.avg("score_accuracy").alias("avg_accuracy"), F.avg("score_quality").alias("avg_quality"),
                 F.count(F.lit(1)).cast("long").alias("n_cases")))


def mark_failures(results: DataFrame) -> DataFrame:
    """Rows with 100 % error or more are failures."""
    return results.withColumn("Success", F.col("Success") & (F.col("Error_Percent") < 100))


def mae_summary(results: DataFrame) -> DataFrame:
    """Per model over successes (error < 100 %): mean/min/max kcal
    error, mean % error, mean time; total time over all rows; success text
    ``k/n`` (K18: the actual count); NULLs when nothing succeeded; numpy
    rounding to 2 decimals."""
    r = mark_failures(results)
    ok = F.col("Success") & (F.col("Error_Percent") < 100)

    def s(c):
        return F.when(ok, F.col(c))

    g = r.groupBy("Model").agg(
        F.sum(ok.cast("int")).alias("_k"), F.count(F.lit(1)).alias("_n"),
        F.avg(s("Error_kcal")).alias("MAE_kcal"), F.avg(s("Error_Percent")).alias("MAE_Percent"),
        F.min(s("Error_kcal")).alias("Min_Error_kcal"), F.max(s("Error_kcal")).alias("Max_Error_kcal"),
        F.avg(s("Processing_Time")).alias("Avg_Time_s"), F.sum("Processing_Time").alias("Total_Time_s"))
    num = ["MAE_kcal", "MAE_Percent", "Min_Error_kcal", "Max_Error_kcal", "Avg_Time_s", "Total_Time_s"]
    return g.select("Model", F.concat_ws("/", F.col("_k").cast("string"), F.col("_n").cast("string")).alias("Success_Rate"),
                    *[np_round(F.col(c), 2).alias(c) for c in num])


def success_failure_counts(results: DataFrame) -> DataFrame:
    """A14."""
    r = mark_failures(results)
    return r.groupBy("Model").agg(F.sum(F.col("Success").cast("long")).alias("successes"),
                                  F.sum((~F.col("Success")).cast("long")).alias("failures"))


def overall_kpis(results: DataFrame) -> DataFrame:
    """Total, successes, success rate %, mean error of successes, mean
    time; zeros for an empty input."""
    r = mark_failures(results)
    total = F.count(F.lit(1))
    succ = F.coalesce(F.sum(F.col("Success").cast("long")), F.lit(0))
    return r.agg(total.cast("long").alias("total"), succ.cast("long").alias("successes"),
                 F.coalesce(F.try_divide(succ * 100.0, total), F.lit(0.0)).alias("success_rate"),
                 F.coalesce(F.avg(F.when(F.col("Success"), F.col("Error_Percent"))), F.lit(0.0)).alias("avg_error_pct"),
                 F.coalesce(F.avg("Processing_Time"), F.lit(0.0)).alias("avg_time_s"))


def error_pivot(results: DataFrame, models: list[str]) -> DataFrame:
    """Profile x Model mean error of successes (explicit pivot values:
    no extra job to discover them)."""
    r = mark_failures(results).where(F.col("Success"))
    return r.groupBy("Profile").pivot("Model", models).agg(F.avg("Error_Percent"))


def success_matrix(results: DataFrame, models: list[str]) -> DataFrame:
    """Profile x Model success as 0/1 (max: order independent)."""
    r = mark_failures(results)
    return r.groupBy("Profile").pivot("Model", models).agg(F.max(F.col("Success").cast("int")))


def generation_time_stats(df: DataFrame, col: str, group: list[str]) -> DataFrame:
    """Count, mean, min, max, sample stddev."""
    return df.groupBy(*group).agg(F.count(col).cast("long").alias("n"), F.avg(col).alias("avg"),
                                  F.min(col).alias("min"), F.max(col).alias("max"),
                                  F.stddev_samp(col).alias("stddev"))


def box_stats(df: DataFrame, group: list[str], col: str, tiebreak: str) -> DataFrame:
    """Min, quartiles, max per group (exact, linear interpolation)."""
    q = exact_quantiles(df, group, col, [0.0, 0.25, 0.5, 0.75, 1.0], tiebreak)
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return q.groupBy(*group).pivot("q", list(names)).agg(F.first("value")) \
        .select(*group, *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def latency_percentiles(df: DataFrame, group: list[str], col: str, tiebreak: str) -> DataFrame:
    """Mean, median, p95 (linear) and throughput 1000 / mean."""
    q = exact_quantiles(df, group, col, [0.5, 0.95], tiebreak)
    p = q.groupBy(*group).pivot("q", [0.5, 0.95]).agg(F.first("value")) \
        .select(*group, F.col("`0.5`").alias("median"), F.col("`0.95`").alias("p95"))
    m = df.groupBy(*group).agg(F.avg(col).alias("mean"))
    return m.join(p, group).withColumn("throughput", F.try_divide(F.lit(1000.0), F.col("mean")))


def latency_ttest_stats(df: DataFrame, group_col: str, col: str, a: str, b: str) -> DataFrame:
    """Equal-variance t statistic (sample variances), Cohen's d with
    population variances (K22), |d| label; one aggregate row."""
    def agg(lbl, tag):
        x = F.when(F.col(group_col) == lbl, F.col(col))
        return [F.count(x).alias(f"n_{tag}"), F.avg(x).alias(f"m_{tag}"),
                F.var_samp(x).alias(f"vs_{tag}"), F.var_pop(x).alias(f"vp_{tag}")]
    g = df.agg(*agg(a, "a"), *agg(b, "b"))
    n1, n2, m1, m2 = (F.col("n_a"), F.col("n_b"), F.col("m_a"), F.col("m_b"))
    sp2 = ((n1 - 1) * F.col("vs_a") + (n2 - 1) * F.col("vs_b")) / (n1 + n2 - 2)
    t = (m1 - m2) / F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    d = F.abs((m1 - m2) / F.sqrt((F.col("vp_a") + F.col("vp_b")) / 2))
    label = F.when(d < EFFECT_LABELS[0][0], F.lit(EFFECT_LABELS[0][1]))
    for thr, name in EFFECT_LABELS[1:]:
        label = label.when(d < thr, F.lit(name))
    label = label.otherwise(F.lit("Large"))
    return g.select(t.alias("t_statistic"), (n1 + n2 - 2).cast("long").alias("dof"), d.alias("cohens_d"),
                    label.alias("effect"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p value of Student's t: I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def latency_ttest(df: DataFrame, group_col: str, col: str, a: str, b: str) -> DataFrame:
    """A25 with the p value: the statistics are one Spark aggregate row; the
    p value is computed on that single row (scipy is not available)."""
    from larder.session import ship_package
    ship_package(df.sparkSession)
    stats = latency_ttest_stats(df, group_col, col, a, b)

    def add_p(it):
        for pdf in it:
            pdf["p_value"] = [t_two_sided_p(t, v) for t, v in zip(pdf["t_statistic"], pdf["dof"])]
            pdf["significant"] = pdf["p_value"] < 0.05
            yield pdf
    return stats.mapInPandas(add_p, "t_statistic double, dof long, cohens_d double, effect string, "
                                    "p_value double, significant boolean")


def best_worst_flags(df: DataFrame, score: str, latency: str) -> DataFrame:
    """Rows equal to the best/worst score and latency; the extremes are
    one global aggregate, one row that every row meets."""
    ends = df.agg(F.max(score).alias("_smax"), F.min(score).alias("_smin"),
                  F.min(latency).alias("_lmin"), F.max(latency).alias("_lmax"))
    return (df.join(F.broadcast(ends))  # one row
            .withColumn("is_best_score", F.col(score) == F.col("_smax")).withColumn("is_worst_score", F.col(score) == F.col("_smin"))
            .withColumn("is_fastest", F.col(latency) == F.col("_lmin")).withColumn("is_slowest", F.col(latency) == F.col("_lmax"))
            .drop("_smax", "_smin", "_lmin", "_lmax"))


def model_rank(summary: DataFrame, metric: str = "MAE_Percent", top: int = 3) -> DataFrame:
    """Models with a value, ascending (ties: model name); the top n
    via TakeOrderedAndProject, numbered afterwards (a window over n rows)."""
    best = (summary.where(F.col(metric).isNotNull())
            .orderBy(F.col(metric).asc(), F.col("Model").asc()).limit(top))
    w = Window.orderBy(F.col(metric).asc(), F.col("Model").asc())
    return best.withColumn("rank", F.row_number().over(w))


def paper_constant_join(summary: DataFrame, spark: SparkSession) -> DataFrame:
    """Summary LEFT JOIN the published constants (literal,
    broadcast), with the difference ours - paper."""
    paper = F.broadcast(spark.createDataFrame(PAPER_MAE, "Model string, Paper_MAE_Percent double"))
    return (summary.join(paper, "Model", "left")
            .withColumn("Difference", F.col("MAE_Percent") - F.col("Paper_MAE_Percent")))


def ground_truth_verdict(df: DataFrame, pairs: list[tuple[str, str]], tol: float = 0.2) -> Column:
    """CORRECT when every (generated, truth) pair is within +-tol of the truth."""
    cond = F.lit(True)
    for g, t in pairs:
        cond = cond & (F.abs(F.col(g) - F.col(t)) <= tol * F.col(t))
    return F.when(cond, F.lit("CORRECT")).otherwise(F.lit("INCORRECT"))


def actual_intent(plan: Column, error: Column) -> Column:
    """The first action of a router's plan (a JSON array of steps);
    ``unknown`` for an empty, missing or unreadable plan, ``ERROR`` for a case
    that failed."""
    steps = F.from_json(plan, "array<struct<action string>>")
    return F.when(error.isNotNull(), F.lit("ERROR")).otherwise(F.coalesce(F.get(steps, F.lit(0))["action"], F.lit("unknown")))


def intent_accuracy(cases: DataFrame) -> DataFrame:
    """Share of cases whose actual intent is the expected one, by
    category and complexity."""
    hit = F.when(F.col("actual_intent") == F.col("expected_intent"), 1.0).otherwise(0.0)
    return cases.groupBy("category", "complexity").agg(F.avg(hit).alias("intent_accuracy"), F.count(F.lit(1)).cast("long").alias("n_cases"))
