"""Vector retrieval and retrieval-evaluation queries over ``embeddings``
(joined to ``part`` for names): queries are category centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import vector as vf
from larder.operators import marts as m
from larder.operators import vectors as vx
from larder.operators.common import global_index
from larder.plans import analogues as an
from larder.plans.q_marts import MART_MEAL_PLANNING_SQL
from larder.plans.registry import register
from larder.session import run_dir
from larder.sources.sinks import materialize_table
from larder.sources.tables import table


def food_vectors(spark, d):
    e = table(spark, d, "embeddings")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return e.join(p, e.vec_id == p.p_partkey).select(
        F.col("vec_id").alias("fdc_id"), F.col("p_name").alias("food_name"), F.col("label").alias("category"),
        F.col("p_type").alias("food_type"), "embedding")


FV = """SELECT e.vec_id AS fdc_id, p.p_name AS food_name, e.label AS category, p.p_type AS food_type, e.embedding
FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey"""


def model_b(df):
    """Second back-end: signed-square transform of the same vectors."""
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * F.abs(x.cast("double"))))


FV_B = f"SELECT fdc_id, food_name, category, food_type, list_transform(embedding, lambda x: x::DOUBLE * abs(x::DOUBLE)) AS embedding FROM ({FV})"


def centroid_sql(src, keys):
    k = ", ".join(keys)
    return f"""SELECT {k}, list(v ORDER BY pos) AS qvec FROM (
  SELECT {k}, pos, avg(x::DOUBLE) AS v FROM (SELECT {k}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM ({src}))
  GROUP BY ALL) GROUP BY ALL"""


def cos_sql(a, b):
    return (f"(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))))")


Q_SQL = f"SELECT category AS qid, qvec FROM ({centroid_sql(FV, ['category'])})"


def queries(spark, d):
    return vx.centroids(food_vectors(spark, d), ["category"]).withColumnRenamed("category", "qid")


def single_query(spark, d, cat=0):
    q = vx.centroids(food_vectors(spark, d).where(F.col("category") == cat), ["category"])
    return q.select("qvec").scalar()


def topk_sql(k, src=FV):
    return f"""SELECT * FROM (SELECT q.qid, v.fdc_id, v.food_name, v.category, v.food_type, {cos_sql('v.embedding', 'q.qvec')} AS similarity,
  CAST(ROW_NUMBER() OVER (PARTITION BY q.qid ORDER BY {cos_sql('v.embedding', 'q.qvec')} DESC NULLS LAST, v.fdc_id) AS INTEGER) AS rank
  FROM ({src}) v, ({centroid_sql(FV, ['category'])}) c, (SELECT c2.category AS qid, c2.qvec FROM ({centroid_sql(FV, ['category'])}) c2) q
  WHERE c.category = q.qid) WHERE rank <= {k}"""


def topk(spark, d, k, b=False):
    v = food_vectors(spark, d)
    return vx.vector_topk_batch(model_b(v) if b else v, queries(spark, d), k)


def _r6(c):
    return F.round(c, 6)


TOP_COLS = ["qid", "fdc_id", "rank"]


@register("cosine_similarity", f"""SELECT v.fdc_id, round({cos_sql('v.embedding', 'c.qvec')}, 6) AS similarity
FROM ({FV}) v JOIN ({centroid_sql(FV, ['category'])}) c ON v.category = c.category""")
def q_cosine_similarity(spark, d):
    v = food_vectors(spark, d)
    c = vx.centroids(v, ["category"])
    return v.join(c, "category").select("fdc_id", _r6(vf.cosine("embedding", "qvec")).alias("similarity"))


_Q0 = f"(SELECT qvec FROM ({centroid_sql(FV, ['category'])}) WHERE category = 0)"
_Q0F = f"(SELECT qvec FROM ({centroid_sql(f'SELECT * FROM ({FV}) WHERE category = 0', ['category'])}))"


@register("query_cross_join", f"SELECT v.fdc_id, round({cos_sql('v.embedding', 'q.qvec')}, 6) AS similarity FROM ({FV}) v, {_Q0F} q")
def q_query_cross_join(spark, d):
    v = food_vectors(spark, d)
    return vx.score_all(v, single_query(spark, d)).select("fdc_id", _r6(F.col("similarity")).alias("similarity"))


@register("scalar_subquery_score", f"SELECT v.fdc_id, round({cos_sql('v.embedding', 'q.qvec')}, 6) AS similarity FROM ({FV}) v, {_Q0F} q")
def q_scalar_subquery_score(spark, d):
    # the same score written as SQL with a scalar subquery for the query vector
    food_vectors(spark, d).createOrReplaceTempView("larder_food_vectors")
    vx.centroids(food_vectors(spark, d).where("category = 0"), ["category"]).createOrReplaceTempView("larder_query0")
    return spark.sql("""
        WITH v AS (SELECT fdc_id, embedding, (SELECT qvec FROM larder_query0) AS q FROM larder_food_vectors)
        SELECT fdc_id, round(try_divide(
                 aggregate(zip_with(embedding, q, (x, y) -> double(x) * double(y)), 0D, (a, x) -> a + x),
                 sqrt(aggregate(embedding, 0D, (a, x) -> a + double(x) * double(x)))
                 * sqrt(aggregate(q, 0D, (a, x) -> a + x * x))), 6) AS similarity
        FROM v""")


@register("vector_topk", f"""SELECT fdc_id, round(s, 6) AS similarity FROM (
  SELECT v.fdc_id, {cos_sql('v.embedding', 'q.qvec')} AS s FROM ({FV}) v, {_Q0F} q ORDER BY s DESC NULLS LAST, v.fdc_id LIMIT 5)""")
def q_vector_topk(spark, d):
    r = vx.vector_topk(food_vectors(spark, d), single_query(spark, d), 5)
    return r.select("fdc_id", _r6(F.col("similarity")).alias("similarity"))


@register("vector_topk_batch", f"SELECT qid, fdc_id, rank, round(similarity, 6) AS similarity FROM ({topk_sql(5)})")
def q_vector_topk_batch(spark, d):
    return topk(spark, d, 5).select(*TOP_COLS, _r6(F.col("similarity")).alias("similarity"))


def _overlap_sql(k=5):
    return f"""SELECT q.qid, COALESCE(n, 0) / {k} AS overlap_at_k FROM (SELECT DISTINCT category AS qid FROM ({FV})) q LEFT JOIN (
  SELECT a.qid, COUNT(*) AS n FROM (SELECT DISTINCT qid, food_name FROM ({topk_sql(k)})) a
  JOIN (SELECT DISTINCT qid, food_name FROM ({topk_sql(k, FV_B)})) b ON a.qid = b.qid AND a.food_name = b.food_name GROUP BY a.qid) x ON q.qid = x.qid"""


@register("topk_overlap_at5", _overlap_sql())
def q_topk_overlap_at5(spark, d):
    return vx.topk_overlap(topk(spark, d, 5), topk(spark, d, 5, b=True), 5)


@register("result_overlap", f"SELECT qid, overlap_at_k * 100 AS overlap_pct FROM ({_overlap_sql()})")
def q_result_overlap(spark, d):
    o = vx.topk_overlap(topk(spark, d, 5), topk(spark, d, 5, b=True), 5)
    return o.select("qid", (F.col("overlap_at_k") * 100).alias("overlap_pct"))


def query_terms(spark, d):
    """Query text per category: its most frequent name word (ties: smaller)."""
    v = food_vectors(spark, d)
    w = v.select("category", F.explode(F.split(F.lower("food_name"), " ")).alias("word"))
    c = w.groupBy("category", "word").agg(F.count(F.lit(1)).alias("n"))
    # deterministic argmax: highest count, then smallest word
    ranked = c.groupBy("category").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("query_text"))
    return ranked.select(F.col("category").alias("qid"), "query_text",
                         F.split(F.lower("query_text"), " ").alias("terms"))


TERMS_SQL = f"""SELECT category AS qid, arg_min(word, (-n, word)) AS query_text FROM (
  SELECT category, word, COUNT(*) AS n FROM (SELECT category, unnest(string_split(lower(food_name), ' ')) AS word FROM ({FV}))
  GROUP BY ALL) GROUP BY category"""


@register("term_relevance", f"""SELECT t.qid, SUM(CASE WHEN contains(lower(r.food_name), lower(t.query_text)) THEN 1 ELSE 0 END) / 5 AS term_relevance
FROM (SELECT DISTINCT qid, food_name FROM ({topk_sql(5)})) r JOIN ({TERMS_SQL}) t ON r.qid = t.qid GROUP BY t.qid""")
def q_term_relevance(spark, d):
    return vx.term_relevance(topk(spark, d, 5), query_terms(spark, d))


@register("result_diversity", f"SELECT qid, COUNT(DISTINCT food_type) / 20 AS diversity FROM ({topk_sql(20)}) GROUP BY qid")
def q_result_diversity(spark, d):
    return vx.result_diversity(topk(spark, d, 20))


@register("avg_relevance", f"SELECT qid, round(avg(similarity), 6) AS avg_relevance FROM ({topk_sql(5)}) GROUP BY qid")
def q_avg_relevance(spark, d):
    return vx.avg_relevance(topk(spark, d, 5)).select("qid", _r6(F.col("avg_relevance")).alias("avg_relevance"))


RAG_CTX_SQL = lambda src: f"""SELECT qid, string_agg('- ' || food_name || ' (category ' || CAST(category AS VARCHAR) || ')', chr(10) ORDER BY rank) AS context
FROM ({topk_sql(5, src)}) GROUP BY qid"""  # noqa: E731


@register("rag_context", RAG_CTX_SQL(FV))
def q_rag_context(spark, d):
    return vx.rag_context(topk(spark, d, 5))


@register("context_usage", f"""SELECT a.qid, SUM(CASE WHEN contains(lower(c.context), lower(a.food_name)) THEN 1 ELSE 0 END) / COUNT(*) AS context_usage
FROM ({topk_sql(5)}) a JOIN ({RAG_CTX_SQL(FV_B)}) c ON a.qid = c.qid GROUP BY a.qid""")
def q_context_usage(spark, d):
    a = topk(spark, d, 5)
    ctx = vx.rag_context(topk(spark, d, 5, b=True))
    names = a.groupBy("qid").agg(F.collect_list("food_name").alias("names"))  # k names per query
    return names.join(ctx, "qid").select("qid", vx.share_found(F.col("context"), F.col("names")).alias("context_usage"))


# Response times: events stand for the log of answered queries, views of one
# back-end and clicks of the other.
TIMED_BACKENDS = [("view", "A"), ("click", "B")]
TIMES_SQL = f"""SELECT {an._case_sql('event_type', TIMED_BACKENDS)} AS backend, user_id % 10 AS qid, avg(value) AS response_ms
FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"""


def response_times(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin(*[k for k, _ in TIMED_BACKENDS]))
    return e.groupBy(an._case(F.col("event_type"), TIMED_BACKENDS).alias("backend"), (F.col("user_id") % 10).alias("qid")) \
        .agg(F.avg("value").alias("response_ms"))


@register("rag_aggregate", f"""WITH top AS (SELECT 'A' AS backend, * FROM ({topk_sql(5)}) UNION ALL SELECT 'B', * FROM ({topk_sql(5, FV_B)})),
  ctx AS (SELECT 'A' AS backend, * FROM ({RAG_CTX_SQL(FV)}) UNION ALL SELECT 'B', * FROM ({RAG_CTX_SQL(FV_B)})),
  rel AS (SELECT backend, qid, avg(similarity) AS relevance FROM top GROUP BY ALL),
  cov AS (SELECT backend, y.qid, SUM(CASE WHEN contains(lower(food_name), lower(query_text)) THEN 1 ELSE 0 END) / 5 AS coverage
    FROM (SELECT DISTINCT backend, qid, food_name FROM top) y JOIN ({TERMS_SQL}) t ON y.qid = t.qid GROUP BY ALL),
  used AS (SELECT t.backend, t.qid, SUM(CASE WHEN contains(lower(c.context), lower(t.food_name)) THEN 1 ELSE 0 END) / COUNT(*) AS usage
    FROM top t JOIN ctx c ON c.qid = t.qid AND c.backend <> t.backend GROUP BY ALL),
  s AS (SELECT backend, avg(relevance) AS relevance, avg(response_ms) AS response_ms, avg(usage) AS usage, avg(coverage) AS coverage
    FROM rel JOIN cov USING (backend, qid) JOIN used USING (backend, qid) JOIN ({TIMES_SQL}) USING (backend, qid) GROUP BY backend)
SELECT backend, round(relevance, 6) AS relevance, round(response_ms, 6) AS response_ms, round(usage, 6) AS usage, round(coverage, 6) AS coverage,
  round(relevance * coverage, 6) AS score, backend = (SELECT arg_max(backend, (relevance * coverage, backend)) FROM s) AS is_winner FROM s""")
def q_rag_aggregate(spark, d):
    # both result tables are written once; everything else reads their few rows
    top = topk(spark, d, 5).withColumn("backend", F.lit("A")).unionByName(topk(spark, d, 5, b=True).withColumn("backend", F.lit("B")))
    top = materialize_table(top, run_dir(spark, "larder/rag_aggregate/top"))
    r = vx.rag_aggregate(top, query_terms(spark, d).select("qid", "terms"), response_times(spark, d))
    return r.select("backend", *[_r6(F.col(c)).alias(c) for c in ("relevance", "response_ms", "usage", "coverage", "score")], "is_winner")


@register("union_model_results", f"""SELECT 'A' AS backend, qid, fdc_id, rank FROM ({topk_sql(5)})
UNION ALL SELECT 'B', qid, fdc_id, rank FROM ({topk_sql(5, FV_B)})""")
def q_union_model_results(spark, d):
    a = topk(spark, d, 5).select(F.lit("A").alias("backend"), *TOP_COLS)
    b = topk(spark, d, 5, b=True).select(F.lit("B").alias("backend"), *TOP_COLS)
    return a.unionByName(b)


MART_FOODS = f"SELECT fdc_id, food_name, category, calories, protein, total_fat, carbohydrate, fiber, sodium FROM ({MART_MEAL_PLANNING_SQL})"


def mart(spark, d):
    return m.mart_meal_planning(an.macros(spark, d))


@register("vector_join_mart", f"""SELECT v.fdc_id, mp.fdc_id AS mart_fdc_id, mp.food_name, mp.calories, round({cos_sql('v.embedding', 'q.qvec')}, 6) AS similarity
FROM ({FV}) v JOIN ({MART_FOODS}) mp ON v.food_name = mp.food_name, {_Q0F} q""")
def q_vector_join_mart(spark, d):
    v = vx.score_all(food_vectors(spark, d), single_query(spark, d))
    # analogue ids of vectors and mart rows differ, so the join key is the name
    mt = mart(spark, d).select(F.col("fdc_id").alias("mart_fdc_id"), "food_name", "calories")
    return v.join(mt, "food_name").select("fdc_id", "mart_fdc_id", "food_name", "calories",
                                          _r6(F.col("similarity")).alias("similarity"))


@register("semi_join_names", f"""SELECT fdc_id, food_name FROM ({MART_FOODS}) WHERE food_name IN (SELECT food_name FROM ({topk_sql(5)}))""")
def q_semi_join_names(spark, d):
    names = topk(spark, d, 5).select("food_name")
    return mart(spark, d).join(names, "food_name", "left_semi").select("fdc_id", "food_name")


@register("foods_in_list", f"""SELECT food_name, COALESCE(calories, 0) AS calories, COALESCE(protein, 0) AS protein,
  COALESCE(carbohydrate, 0) AS carbohydrate, COALESCE(total_fat, 0) AS total_fat FROM ({MART_FOODS})
WHERE food_name IN (SELECT food_name FROM ({topk_sql(5)}) WHERE qid = 0)""")
def q_foods_in_list(spark, d):
    names = topk(spark, d, 5).where(F.col("qid") == 0).select("food_name")
    mt = mart(spark, d).join(names, "food_name", "left_semi")
    return mt.select("food_name", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                    for c in ("calories", "protein", "carbohydrate", "total_fat")])


@register("foods_like_pattern", f"SELECT fdc_id, food_name FROM ({MART_FOODS}) WHERE lower(food_name) LIKE lower('%WIDGET%')")
def q_foods_like_pattern(spark, d):
    return mart(spark, d).where(F.lower("food_name").like("%WIDGET%".lower())).select("fdc_id", "food_name")


ITEM_Q_SQL = f"SELECT category AS user_id, food_type AS item, qvec FROM ({centroid_sql(FV, ['category', 'food_type'])})"
BEST_SQL = f"""SELECT user_id, item, fdc_id, round(s, 6) AS similarity FROM (
  SELECT q.user_id, q.item, v.fdc_id, {cos_sql('v.embedding', 'q.qvec')} AS s,
    ROW_NUMBER() OVER (PARTITION BY q.user_id, q.item ORDER BY {cos_sql('v.embedding', 'q.qvec')} DESC NULLS LAST, v.fdc_id) AS rn
  FROM ({FV}) v, ({ITEM_Q_SQL}) q) WHERE rn = 1 AND s > 0.6"""


def best_matches(spark, d):
    v = food_vectors(spark, d)
    items = vx.centroids(v, ["category", "food_type"]).select(
        F.concat_ws("|", F.col("category").cast("string"), "food_type").alias("qid"),
        F.col("category").alias("user_id"), F.col("food_type").alias("item"), "qvec")
    top1 = vx.vector_topk_batch(v, items.select("qid", "qvec"), 1)
    return (top1.where(F.col("similarity") > 0.6)
            .join(items.select("qid", "user_id", "item"), "qid"))


@register("best_match_join", BEST_SQL)
def q_best_match_join(spark, d):
    return best_matches(spark, d).select("user_id", "item", "fdc_id", _r6(F.col("similarity")).alias("similarity"))


@register("inventory_resolution", f"""SELECT u.user_id, CAST(COALESCE(n, 0) AS BIGINT) AS matched_items, COALESCE(n, 0) >= 5 AS can_plan
FROM (SELECT DISTINCT category AS user_id FROM ({FV})) u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM ({BEST_SQL}) GROUP BY user_id) b
  ON u.user_id = b.user_id""")
def q_inventory_resolution(spark, d):
    b = best_matches(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    u = food_vectors(spark, d).select(F.col("category").alias("user_id")).distinct()
    j = u.join(b, "user_id", "left")
    return j.select("user_id", F.coalesce("n", F.lit(0)).cast("long").alias("matched_items"),
                    (F.coalesce("n", F.lit(0)) >= 5).alias("can_plan"))


@register("context_size_choice", f"""SELECT qid, arg_max(k, (score, -k)) AS best_k, round(max(score), 6) AS best_score FROM (
  SELECT qid, k, 0.7 * avg(similarity) + 0.3 * COUNT(DISTINCT food_type) / COUNT(*) AS score
  FROM ({topk_sql(20)}) t, (VALUES (3), (5), (10), (20)) ks(k) WHERE t.rank <= ks.k GROUP BY qid, k) GROUP BY qid""")
def q_context_size_choice(spark, d):
    c = vx.context_size_choice(topk(spark, d, 20))
    return c.select("qid", "best_k", _r6(F.col("best_score")).alias("best_score"))


@register("vector_distribution", f"""WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM ({FV})),
p AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY pos)
SELECT round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS std_of_means, round(avg(s), 6) AS mean_of_stds,
  (SELECT round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) FROM ({FV})) AS avg_norm FROM p""")
def q_vector_distribution(spark, d):
    r = vx.vector_distribution(food_vectors(spark, d))
    return r.select(*[_r6(F.col(c)).alias(c) for c in r.columns])


@register("intra_category_similarity", f"""WITH f AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY fdc_id) AS rn FROM ({FV})) WHERE rn <= 10),
ok AS (SELECT category FROM f GROUP BY category HAVING COUNT(*) >= 10)
SELECT a.category, round(avg({cos_sql('a.embedding', 'b.embedding')}), 6) AS avg_similarity
FROM f a JOIN f b ON a.category = b.category AND a.rn < b.rn WHERE a.category IN (SELECT category FROM ok) GROUP BY a.category""")
def q_intra_category_similarity(spark, d):
    r = vx.intra_category_similarity(food_vectors(spark, d))
    return r.select("category", _r6(F.col("avg_similarity")).alias("avg_similarity"))


@register("category_coverage", f"SELECT CAST(COUNT(DISTINCT category) AS BIGINT) AS categories FROM ({FV}) WHERE category IS NOT NULL")
def q_category_coverage(spark, d):
    v = food_vectors(spark, d).where(F.col("category").isNotNull())
    return v.agg(F.countDistinct("category").cast("long").alias("categories"))


@register("vector_storage", """SELECT CAST(COUNT(*) AS BIGINT) AS n_vectors, CAST(max(len(embedding)) AS BIGINT) AS dim,
  round(COUNT(*) * max(len(embedding)) * 4 / (1024 * 1024), 6) AS storage_mb, round(max(len(embedding)) * 4 / 1024, 6) AS kb_per_vector,
  round((1 - 768 / 1536) * 100, 6) AS saving_768_vs_1536_pct FROM embeddings""")
def q_vector_storage(spark, d):
    s = vx.vector_storage(table(spark, d, "embeddings"))
    return s.select("n_vectors", "dim", _r6(F.col("storage_mb")).alias("storage_mb"),
                    _r6(F.col("kb_per_vector")).alias("kb_per_vector"),
                    _r6(vx.storage_saving_pct(F.lit(768.0), F.lit(1536.0))).alias("saving_768_vs_1536_pct"))


@register("vector_dim_check", """SELECT vec_id AS fdc_id, embedding IS NOT NULL AND len(embedding) = 64
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL)) AS dim_ok FROM embeddings""")
def q_vector_dim_check(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("fdc_id"), "embedding")
    return vx.vector_dim_check(v, 64).select("fdc_id", "dim_ok")


_ET = """'Food: ' || food_name || ' Category: ' || COALESCE(category, 'Unknown') || ' Calories: ' || COALESCE(CAST(calories AS VARCHAR), 'N/A')
  || ' Protein: ' || COALESCE(CAST(protein AS VARCHAR), 'N/A') || 'g' || ' Carbs: ' || COALESCE(CAST(carbohydrate AS VARCHAR), 'N/A') || 'g'
  || ' Fat: ' || COALESCE(CAST(total_fat AS VARCHAR), 'N/A') || 'g'"""
_ET_MICRO = """ || ' Fiber: ' || COALESCE(CAST(fiber AS VARCHAR), 'N/A') || 'g' || ' Sodium: ' || COALESCE(CAST(sodium AS VARCHAR), 'N/A') || 'mg'"""


@register("embedding_text", f"SELECT fdc_id, {_ET}{_ET_MICRO} AS embedding_text, {_ET} AS embedding_text_short FROM ({MART_FOODS}) WHERE food_name IS NOT NULL")
def q_embedding_text(spark, d):
    # both variants are projections of one mart row
    return vx.embedding_text(mart(spark, d)).select("fdc_id", "embedding_text", vx.labelled_text(False).alias("embedding_text_short"))


# Fixed value: how many foods were embedded, the first by id.
FIRST_N = 10_000


@register("embedding_text_first_n", f"SELECT fdc_id, {_ET}{_ET_MICRO} AS embedding_text FROM ({MART_FOODS}) WHERE food_name IS NOT NULL ORDER BY fdc_id LIMIT {FIRST_N}")
def q_embedding_text_first_n(spark, d):
    return vx.embedding_text(mart(spark, d), first_n=FIRST_N).select("fdc_id", "embedding_text")


def counts_sql(ids, text, src, dim=64):
    """Signed token counts of ``dim`` buckets per id, as a list of doubles."""
    return f"""SELECT {ids}, list(coalesce(s, 0)::DOUBLE ORDER BY b) AS vec FROM (
  SELECT {ids}, b, sum(s) AS s FROM (
    SELECT {ids}, CASE WHEN t = '' THEN 0 ELSE ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} END AS b,
      CASE WHEN t = '' THEN 0 WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END AS s
    FROM (SELECT {ids}, unnest(list_append(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), '')) AS t FROM ({src}))
    UNION ALL SELECT {ids}, unnest(range({dim})), 0 FROM ({src})) GROUP BY ALL) GROUP BY ALL"""


@register("hash_embedding", f"""SELECT doc_id, CAST(len(vec) AS BIGINT) AS dim, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6) AS norm,
  array_to_string(list_transform(vec, lambda x: CASE WHEN n > 0 THEN round(x / n * 1000000)::BIGINT ELSE 0 END), ',') AS micro
FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM ({counts_sql('doc_id', 'text', 'SELECT doc_id, text FROM documents')}))""")
def q_hash_embedding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    h = vx.hash_embedding(docs, "text", "doc_id", 64)
    # the vector itself, in millionths
    micro = F.array_join(F.transform("embedding", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")
    return h.select("doc_id", F.size("embedding").cast("long").alias("dim"), _r6(vf.norm("embedding")).alias("norm"), micro.alias("micro"))


@register("batch_slices", f"SELECT fdc_id, CAST(ROW_NUMBER() OVER (ORDER BY fdc_id) AS BIGINT) AS row_index, CAST((ROW_NUMBER() OVER (ORDER BY fdc_id) - 1) // 100 AS BIGINT) AS batch FROM ({FV})")
def q_batch_slices(spark, d):
    idx = global_index(food_vectors(spark, d).select("fdc_id"), ["fdc_id"])
    return idx.select("fdc_id", "row_index", ((F.col("row_index") - 1) / 100).cast("long").alias("batch"))


@register("slice_by_minus", f"""SELECT DISTINCT CAST((rn - 1) // 100 AS BIGINT) AS slice, fdc_id, food_name
FROM (SELECT fdc_id, food_name, row_number() OVER (ORDER BY fdc_id) AS rn FROM ({FV}))""")
def q_slice_by_minus(spark, d):
    # slice i is the first 100 (i + 1) rows by id minus the first 100 i: one
    # ranked pass gives every slice, without limits and set differences
    idx = global_index(food_vectors(spark, d).select("fdc_id", "food_name"), ["fdc_id"])
    return idx.select(((F.col("row_index") - 1) / 100).cast("long").alias("slice"), "fdc_id", "food_name").distinct()


@register("factual_accuracy", f"""WITH f AS (SELECT fdc_id, food_name, calories, string_split(food_name, ' ')[-1] AS word FROM ({MART_FOODS})),
t AS (SELECT word, avg(calories) AS truth FROM (SELECT unnest(list_distinct(string_split(lower(food_name), ' '))) AS word, calories FROM f) GROUP BY word)
SELECT f.fdc_id, round(CASE WHEN f.fdc_id % 11 <> 0 THEN greatest(0.0, 1.0 - abs(CAST(trunc(f.calories) AS BIGINT) + 7 - t.truth) / t.truth) END, 6) AS accuracy
FROM f JOIN t ON f.word = t.word""")
def q_factual_accuracy(spark, d):
    return factual_accuracy_rows(spark, d).select("fdc_id", _r6(F.col("accuracy")).alias("accuracy"))


def factual_accuracy_rows(spark, d):
    mt = mart(spark, d).select("fdc_id", "food_name", "calories", "category",
                               F.element_at(F.split("food_name", " "), -1).alias("word"))
    # truth: mean calories of the foods having the word among their name
    # tokens; an equi-join on exploded tokens instead of a LIKE theta join
    tokens = mt.select(F.explode(F.array_distinct(F.split(F.lower("food_name"), " "))).alias("word"),
                       F.col("calories").alias("c"))
    truth = tokens.groupBy("word").agg(F.avg("c").alias("truth"))
    # some replies hold no number
    resp = F.when(F.col("fdc_id") % 11 == 0, F.lit("I am not sure.")).otherwise(
        F.concat(F.lit("Roughly "), (F.col("calories").cast("long") + 7).cast("string"), F.lit(" kcal.")))
    return mt.join(truth, "word").select("fdc_id", "category", vx.factual_accuracy(resp, F.col("truth")).alias("accuracy"))


@register("judge_scores", """SELECT event_id, CASE WHEN n >= 3 THEN CAST(l[1] AS INTEGER) END AS coherence,
  CASE WHEN n >= 3 THEN CAST(l[2] AS INTEGER) END AS completeness, CASE WHEN n >= 3 THEN CAST(l[3] AS INTEGER) END AS accuracy
FROM (SELECT event_id, regexp_extract_all(t, '(\\d+)/10', 1) AS l, len(regexp_extract_all(t, '(\\d+)/10', 1)) AS n FROM (
  SELECT event_id, 'Coherence: ' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS VARCHAR) || '/10, Completeness: '
    || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS VARCHAR) || '/10' ||
    CASE WHEN event_type != 'error' THEN ', Accuracy: ' || CAST(user_id % 10 AS VARCHAR) || '/10' ELSE '' END AS t FROM events))""")
def q_judge_scores(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.concat(F.lit("Coherence: "), (k % 10).cast("string"), F.lit("/10, Completeness: "), (k % 7).cast("string"),
                 F.lit("/10"), F.when(F.col("event_type") != "error",
                                      F.concat(F.lit(", Accuracy: "), (F.col("user_id") % 10).cast("string"), F.lit("/10")))
                 .otherwise(F.lit("")))
    return e.select("event_id", *vx.judge_scores(t))


@register("keyword_coverage", """WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
k AS (SELECT a.conv_id, a.turn, lower(a.text) AS response,
        list_distinct(list_filter(string_split_regex(lower(p.text), '\\s+'), lambda w: length(w) > 3)) AS kw
      FROM m a JOIN m p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, CAST(len(kw) AS BIGINT) AS n_keywords,
  round(CASE WHEN len(kw) = 0 THEN NULL ELSE len(list_filter(kw, lambda w: contains(response, w))) / len(kw) END, 6) AS coverage FROM k""")
def q_keyword_coverage(spark, d):
    # V9: share of the previous message's keywords (words longer than 3) found
    # in the reply; the previous message is an equi-join on (thread, turn - 1)
    c = table(spark, d, "conversations")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    j = a.join(p, ["conv_id", "turn"])
    kw = F.array_distinct(F.filter(F.split(F.lower("prev"), r"\s+"), lambda w: F.length(w) > 3))
    return j.select("conv_id", "turn", F.size(kw).cast("long").alias("n_keywords"),
                    _r6(vx.share_found(F.col("text"), kw)).alias("coverage"))


_TURNS_SQL = f"SELECT thread_id, turn, content FROM ({an.MESSAGES_SQL}) WHERE role = 'user'"
_FOOD_COUNTS_SQL = counts_sql("fdc_id, food_name", "t", f"SELECT fdc_id, food_name, {_ET} AS t FROM ({MART_FOODS}) WHERE food_name IS NOT NULL")


@register("context_retention", f"""WITH c AS ({counts_sql('thread_id, turn', 'content', _TURNS_SQL)}),
  q AS (SELECT thread_id, turn, list(s ORDER BY b) AS qvec FROM (
    SELECT thread_id, turn, b, sum(x) OVER (PARTITION BY thread_id, b ORDER BY turn) AS s
    FROM (SELECT thread_id, turn, unnest(vec) AS x, generate_subscripts(vec, 1) AS b FROM c)) GROUP BY ALL),
  f AS ({_FOOD_COUNTS_SQL}),
  s AS (SELECT q.thread_id, q.turn, f.fdc_id, f.food_name,
    CASE WHEN list_dot_product(q.qvec, q.qvec) > 0 AND list_dot_product(f.vec, f.vec) > 0
      THEN list_dot_product(f.vec, q.qvec) / (sqrt(list_dot_product(f.vec, f.vec)) * sqrt(list_dot_product(q.qvec, q.qvec))) END AS sim FROM q, f),
  n AS (SELECT DISTINCT thread_id, turn, food_name FROM (
    SELECT *, row_number() OVER (PARTITION BY thread_id, turn ORDER BY sim DESC NULLS LAST, fdc_id) AS rn FROM s) WHERE rn <= 3),
  o AS (SELECT thread_id, turn, avg(CASE WHEN seen < turn THEN 1.0 ELSE 0.0 END) AS overlap FROM (
    SELECT *, min(turn) OVER (PARTITION BY thread_id, food_name) AS seen, min(turn) OVER (PARTITION BY thread_id) AS t0 FROM n)
    WHERE turn > t0 GROUP BY ALL)
SELECT thread_id, round(avg(overlap), 6) AS mean_overlap, round(1.0 - stddev_pop(overlap), 6) AS retention FROM o GROUP BY thread_id""")
def q_context_retention(spark, d):
    turns = an.messages(spark, d).where(F.col("role") == "user").select("thread_id", "turn", "content")
    foods = vx.embedding_text(mart(spark, d), False).select("fdc_id", "food_name", "embedding_text")
    r = vx.context_retention(turns, foods)
    return r.select("thread_id", _r6(F.col("mean_overlap")).alias("mean_overlap"), _r6(F.col("retention")).alias("retention"))
