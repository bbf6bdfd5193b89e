"""Exact vector retrieval and its evaluation (V1-V20, J8-J12, A23, A24, A31,
E1, E2, E6, W12, P19, P20).

Search is exact brute force, as in the reference. One query is a scalar
subquery whose value every vector row is scored with inside one projection.
Many queries meet the vectors block by block in matrix products over Arrow
batches (``vector_topk_batch``); only k rows per query leave each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions import blockscore
from larder.functions import vector as vf
from larder.functions.blockscore import BlockTopK
from larder.operators.common import global_index, running_totals

QUERY_BLOCK = 4096          # queries (or vectors) that a task holds at a time
PART_ROWS = 262_144         # vectors that stream past a block in one task, about


def centroids(vectors: DataFrame, key_cols: list[str], vec_col: str = "embedding") -> DataFrame:
    """Mean vector per key: per-dimension averages (partial aggregation per
    (key, dim), so a hot key costs one partial row per task and dimension),
    then one bounded array of ``dim`` values per key."""
    e = vectors.select(*key_cols, F.posexplode(vec_col).alias("pos", "v"))
    per_dim = e.groupBy(*key_cols, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    arr = per_dim.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_s"))
    return arr.select(*key_cols, F.transform("_s", lambda x: x["v"]).alias("qvec"))


def score_all(vectors: DataFrame, query_vec: Column, id_col: str = "fdc_id",
              vec_col: str = "embedding") -> DataFrame:
    """Similarity of every vector to one query vector (a scalar
    subquery value), as a plain projection."""
    return (vectors.withColumn("_q", query_vec)
            .withColumn("similarity", vf.cosine(F.col(vec_col), F.col("_q"))).drop("_q"))


def vector_topk(vectors: DataFrame, query_vec: Column, k: int, id_col: str = "fdc_id",
                vec_col: str = "embedding") -> DataFrame:
    """V3: k most similar (ties: smaller id), as TakeOrderedAndProject."""
    return (score_all(vectors, query_vec, id_col, vec_col)
            .orderBy(F.col("similarity").desc_nulls_last(), F.col(id_col).asc()).limit(k))


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "fdc_id",
                      vec_col: str = "embedding", qid_col: str = "qid",
                      block: int = QUERY_BLOCK) -> DataFrame:
    """V4: top-k per query for a table of queries (qid, qvec).

    Vectors are scored in Arrow batches, a matrix product for a batch and a
    block of queries, and a task holds the k best rows of each query of its
    block. Up to ``block`` queries are one block that is sent to all tasks;
    vectors do not move. Of more queries and up to ``block`` vectors, the
    vectors are sent and the queries stay where they are. Otherwise queries
    are a table of blocks: every part of the vectors meets every block in an
    exchange keyed by both, whose task reads the block first and then streams
    the vectors. Either way the plan has the same size however many queries
    there are.
    Output: qid, rank, id, similarity, plus the vector's other columns; NULL
    similarities (a zero or NULL vector, unequal lengths) rank last.
    """
    keep = [c for c in vectors.columns if c != vec_col]
    v = vectors.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.col(qid_col).alias("qid"), "qvec")
    some = q.limit(block + 1).toArrow()  # block + 1 rows at most
    if some.num_rows <= block:
        best = _scored_by_one(v, q, some, k)
    else:
        few = v.limit(block + 1).toArrow()  # likewise
        best = _scored_in_place(v, q, few, k) if few.num_rows <= block else _scored_by_blocks(v, q, k, block)
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc_nulls_last(), F.col("id").asc())
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("row.*", "qid", "similarity", "rank")


def _result_type(v: DataFrame, q: DataFrame) -> StructType:
    return (v.select("row", "id").schema.add(q.schema["qid"]).add("similarity", "double"))


def _scored_by_one(v: DataFrame, q: DataFrame, block: pa.Table, k: int) -> DataFrame:
    shared = v.sparkSession.sparkContext.broadcast(block.combine_chunks())  # QUERY_BLOCK rows at most

    def score(batches):
        table = shared.value
        best = BlockTopK(*(table[c].combine_chunks() for c in ("qid", "qvec")), k)
        for batch in batches:
            best.add(batch)
        yield from best.results()

    return v.mapInArrow(score, _result_type(v, q))


def _scored_in_place(v: DataFrame, q: DataFrame, vectors: pa.Table, k: int) -> DataFrame:
    shared = v.sparkSession.sparkContext.broadcast(vectors.combine_chunks())  # QUERY_BLOCK rows at most

    def score(batches):
        # small pieces of both sides: many ties make a piece's whole product candidates
        pieces = [p for b in shared.value.to_batches() for p in _pieces(b, blockscore.ROWS)]
        for batch in batches:
            for asking in _pieces(batch, blockscore.QUERIES):
                best = BlockTopK(asking.column("qid"), asking.column("qvec"), k)
                for piece in pieces:
                    best.add(piece)
                yield from best.results()

    return q.mapInArrow(score, _result_type(v, q))


def _pieces(batch: pa.RecordBatch, rows: int) -> list[pa.RecordBatch]:
    return [batch.slice(a, rows) for a in range(0, batch.num_rows, rows)]


def _parts(n_vectors: int, n_blocks: int, tasks: int) -> int:
    """Parts of the vectors: every query goes to each, so as few as give
    ``tasks`` pairs of part and block, and ``PART_ROWS`` rows a part."""
    return max(1, -(-tasks // n_blocks), -(-n_vectors // PART_ROWS))


def _scored_by_blocks(v: DataFrame, q: DataFrame, k: int, block: int) -> DataFrame:
    spark = v.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = global_index(q, ["qid"], name="_at").withColumn("block", F.floor((F.col("_at") - 1) / block))
    n_blocks = q.agg(F.max("block")).collect()[0][0] + 1
    v = v.checkpoint()  # counted, then read once
    parts = _parts(v.count(), n_blocks, tasks)
    row, vec = (v.schema[c].dataType for c in ("row", "vec"))
    # queries go to every part, vectors to every block; the queries of a pair come first
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", F.lit(0).alias("kind"), "qid", "qvec",
                     F.lit(None).cast(row).alias("row"), F.lit(None).cast(v.schema["id"].dataType).alias("id"), F.lit(None).cast(vec).alias("vec"))
    given = v.select(F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).cast("int").alias("part"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"),
                     F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), F.lit(None).cast(q.schema["qvec"].dataType).alias("qvec"), "row", "id", "vec")
    both = asked.unionByName(given).repartition(max(tasks * 4, parts * n_blocks), "part", "block").sortWithinPartitions("part", "block", "kind")

    def score(batches):
        now, asking, best = None, [], None
        for batch in batches:
            pair = batch.column("part").to_numpy() * n_blocks + batch.column("block").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if pair[a] != now:
                    if best is not None:
                        yield from best.results()
                    now, asking, best = pair[a], [], None
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    asking.append(piece.select(["qid", "qvec"]))
                    continue
                if best is None:
                    table = pa.Table.from_batches(asking, asking[0].schema)
                    best = BlockTopK(*(table[c].combine_chunks() for c in ("qid", "qvec")), k)
                best.add(piece.select(["row", "id", "vec"]))
        if best is not None:
            yield from best.results()

    return both.mapInArrow(score, _result_type(v, q))


def topk_overlap(a: DataFrame, b: DataFrame, k: int = 5, key: str = "food_name") -> DataFrame:
    """Per query |set(top-k A) n set(top-k B)| / k (name sets)."""
    sa = a.where(F.col("rank") <= k).select("qid", key).distinct()
    sb = b.where(F.col("rank") <= k).select("qid", key).distinct()
    inter = sa.join(sb, ["qid", key]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    q = a.select("qid").distinct()
    return (q.join(inter, "qid", "left")
            .select("qid", (F.coalesce("n", F.lit(0)) / k).alias("overlap_at_k")))


def term_relevance(results: DataFrame, query_terms: DataFrame, k: int = 5) -> DataFrame:
    """V6: share of distinct top-k names containing any query term."""
    names = results.where(F.col("rank") <= k).select("qid", "food_name").distinct()
    j = names.join(query_terms, "qid")
    hit = F.exists("terms", lambda t: F.contains(F.lower("food_name"), t))
    return j.groupBy("qid").agg((F.sum(hit.cast("int")) / k).alias("term_relevance"))


def result_diversity(results: DataFrame, k: int = 20, cat: str = "food_type") -> DataFrame:
    """V7: distinct non-null categories among the top-k / k."""
    return (results.where(F.col("rank") <= k).groupBy("qid")
            .agg((F.countDistinct(cat) / k).alias("diversity")))


def avg_relevance(results: DataFrame, k: int = 5) -> DataFrame:
    """Mean similarity of the retrieved rows."""
    return results.where(F.col("rank") <= k).groupBy("qid").agg(F.avg("similarity").alias("avg_relevance"))


def share_found(text: Column, terms: Column) -> Column:
    """Share of ``terms`` found (case-insensitive) in ``text``."""
    found = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t))))
    return F.try_divide(found.cast("double"), F.size(terms).cast("double"))


def factual_accuracy(response: Column, truth: Column) -> Column:
    """First number in the response vs the true value:
    max(0, 1 - |p - t| / t); NULL (not counted) without a number or a truth."""
    p = F.regexp_extract(response, r"(\d+\.?\d*)", 1)
    pv = F.when(p == "", F.lit(None)).otherwise(p).try_cast("double")
    score = F.lit(1.0) - F.try_divide(F.abs(pv - truth), truth)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), score))


# Candidate context sizes and the score weights.
CONTEXT_SIZES = [3, 5, 10, 20]
W_SIM, W_DIV = 0.7, 0.3


def context_size_choice(results: DataFrame, cat: str = "food_type") -> DataFrame:
    """For k in (3, 5, 10, 20): 0.7 mean similarity + 0.3 distinct
    categories / rows; the first (smallest) best k per query. Ranked once
    (top-20), then a literal k list is exploded per row (no join)."""
    top = results.where(F.col("rank") <= max(CONTEXT_SIZES))
    x = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in CONTEXT_SIZES]))).where(F.col("rank") <= F.col("k"))
    s = x.groupBy("qid", "k").agg(
        (F.lit(W_SIM) * F.avg("similarity") + F.lit(W_DIV) * F.countDistinct(cat) / F.count(F.lit(1))).alias("score"))
    best = F.max_by(F.struct("k", "score"), F.struct(F.col("score"), -F.col("k")))
    return s.groupBy("qid").agg(best.alias("b")).select("qid", F.col("b.k").alias("best_k"),
                                                        F.col("b.score").alias("best_score"))


def rag_context(results: DataFrame, k: int = 5) -> DataFrame:
    """Per query the retrieved rows as one text block in rank order
    (k rows per query: bounded)."""
    line = F.format_string("- %s (category %s)", F.col("food_name"), F.col("category").cast("string"))
    g = (results.where(F.col("rank") <= k).groupBy("qid")
         .agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_l")))
    return g.select("qid", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("context"))


def vector_distribution(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Per-dimension mean and population std, then mean and
    population std of the means, mean of the stds, and the mean norm."""
    e = vectors.select(F.posexplode(vec_col).alias("pos", "v"))
    per = e.groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("m"),
                               F.stddev_pop(F.col("v").cast("double")).alias("s"))
    stats = per.agg(F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("std_of_means"),
                    F.avg("s").alias("mean_of_stds"))
    avg_norm = vectors.agg(F.avg(vf.norm(vec_col)).alias("avg_norm"))
    return stats.select("*", avg_norm.scalar().alias("avg_norm"))


def intra_category_similarity(vectors: DataFrame, first_n: int = 10, id_col: str = "fdc_id",
                              cat: str = "category", vec_col: str = "embedding") -> DataFrame:
    """Mean cosine over all i<j pairs of the first ``first_n`` vectors
    (by id) of each category with at least ``first_n`` vectors.

    No pairs are formed: with unit vectors u_i and S = sum u_i,
    sum_{i<j} u_i.u_j = (|S|^2 - sum |u_i|^2) / 2. The first n per category
    come from a WindowGroupLimit; S is a per-(category, dim) sum.
    """
    w = Window.partitionBy(cat).orderBy(F.col(id_col).asc())
    first = (vectors.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first_n)
             .select(cat, vf.normalize(vec_col).alias("u")))
    sq = first.select(cat, F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x).alias("uu"))
    sums = sq.groupBy(cat).agg(F.count(F.lit(1)).alias("n"), F.sum("uu").alias("sum_uu"))
    e = first.select(cat, F.posexplode("u").alias("pos", "x"))
    s = e.groupBy(cat, "pos").agg(F.sum("x").alias("sx")).groupBy(cat).agg(F.sum(F.col("sx") * F.col("sx")).alias("ss"))
    j = sums.join(s, cat).where(F.col("n") >= first_n)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return j.select(cat, ((F.col("ss") - F.col("sum_uu")) / 2 / pairs).alias("avg_similarity"))


def vector_storage(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Count x dim x 4 bytes in MB and KB per vector."""
    g = vectors.agg(F.count(F.lit(1)).cast("long").alias("n_vectors"), F.max(F.size(vec_col)).cast("long").alias("dim"))
    return g.select("n_vectors", "dim",
                    (F.col("n_vectors") * F.col("dim") * 4 / (1024 * 1024)).alias("storage_mb"),
                    (F.col("dim") * 4 / 1024).alias("kb_per_vector"))


def storage_saving_pct(dim_small: Column, dim_large: Column) -> Column:
    return (F.lit(1.0) - dim_small / dim_large) * 100


def vector_dim_check(vectors: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Declared dimension and no NULL element."""
    v = F.col(vec_col)
    return vectors.withColumn("dim_ok", v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()))


def judge_scores(text: Column) -> list[Column]:
    """Integers before '/10'; the first three are coherence,
    completeness, accuracy; fewer than three -> NULLs."""
    nums = F.regexp_extract_all(text, F.lit(r"(\d+)/10"), 1)
    ok = F.size(nums) >= 3
    return [F.when(ok, nums[i].cast("int")).alias(n)
            for i, n in enumerate(["coherence", "completeness", "accuracy"])]


def embedding_text(foods: DataFrame, with_micros: bool = True, first_n: int | None = None) -> DataFrame:
    """V1: labelled text per food; NULL category -> Unknown, NULL number ->
    N/A; names must be present. ``with_micros=False`` drops fiber/sodium;
    ``first_n`` keeps the first foods by id."""
    named = foods.where(F.col("food_name").isNotNull())
    if first_n is not None:
        named = named.orderBy("fdc_id").limit(first_n)
    return named.withColumn("embedding_text", labelled_text(with_micros))


def labelled_text(with_micros: bool = True) -> Column:
    """The text of ``embedding_text`` from a mart row's columns."""
    def num(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    parts = [F.lit("Food: "), F.col("food_name"), F.lit(" Category: "), F.coalesce(F.col("category"), F.lit("Unknown")),
             F.lit(" Calories: "), num("calories"), F.lit(" Protein: "), num("protein"), F.lit("g"),
             F.lit(" Carbs: "), num("carbohydrate"), F.lit("g"), F.lit(" Fat: "), num("total_fat"), F.lit("g")]
    if with_micros:
        parts += [F.lit(" Fiber: "), num("fiber"), F.lit("g"), F.lit(" Sodium: "), num("sodium"), F.lit("mg")]
    return F.concat(*parts)


def token_counts(texts: DataFrame, text_col: str, id_cols: list[str], dim: int = 64) -> DataFrame:
    """Per id the signed token counts of ``dim`` buckets, as columns ``t0``,
    ``t1``, ...: a token's md5 names its bucket (first 8 hex digits modulo
    ``dim``) and its sign (the ninth digit). Tokens are exploded and summed, so
    a long text spreads over the shuffle; a text without a token counts 0."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)
    toks = texts.select(*id_cols, F.explode_outer(words).alias("t")).select(*id_cols, F.md5("t").alias("h"))  # one NULL token for a text without any
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.substring("h", 9, 1) < "8", 1).otherwise(-1)
    signed = toks.select(*id_cols, bucket.alias("b"), F.when(F.col("h").isNotNull(), sign).otherwise(0).alias("s"))
    return signed.groupBy(*id_cols).agg(*[F.sum(F.when(F.col("b") == i, F.col("s")).otherwise(0)).alias(f"t{i}") for i in range(dim)])


def hash_embedding(texts: DataFrame, text_col: str, id_col: str, dim: int = 64) -> DataFrame:
    """Deterministic feature-hash vector per text: its token counts,
    L2-normalized; a text without a token, or whose counts cancel out, gets
    the zero vector; stands in for a remote model."""
    vec = F.array(*[F.col(f"t{i}").cast("double") for i in range(dim)])
    dense = token_counts(texts, text_col, [id_col], dim).select(id_col, vec.alias("v"))
    return dense.select(id_col, F.transform(vf.normalize("v"), lambda x: F.coalesce(x, F.lit(0.0))).alias("embedding"))


def context_retention(turns: DataFrame, foods: DataFrame, k: int = 3, dim: int = 64) -> DataFrame:
    """Per thread, for each user turn after the first, the share of the
    turn's retrieved names that were retrieved at an earlier turn; the mean
    and 1 - population std over the turns.

    The query of a turn is the text of all turns up to it (W13). Its vector
    needs no joined text: token counts add up, so each turn is counted once
    and a segmented prefix scan over (thread, turn) gives every query; a
    thread of any length is spread over tasks. A name is "seen" at a turn if
    its first turn in the thread is earlier, so no pairs of turns are formed.
    ``turns``: thread_id, turn, content; ``foods``: fdc_id, food_name,
    embedding_text.
    """
    cols = [f"t{i}" for i in range(dim)]

    def vec(name):
        return F.array(*[F.col(c).cast("double") for c in cols]).alias(name)
    counted = token_counts(turns, "content", ["thread_id", "turn"], dim)
    asked = running_totals(counted, ["thread_id"], ["turn"], cols).select(F.struct("thread_id", "turn").alias("qid"), vec("qvec")).checkpoint()  # sized up, then scored
    known = token_counts(foods, "embedding_text", ["fdc_id", "food_name"], dim).select("fdc_id", "food_name", vec("embedding"))
    top = vector_topk_batch(known, asked, k)
    names = top.select("qid.thread_id", "qid.turn", "food_name").distinct().checkpoint()  # read twice, scored once
    first = names.groupBy("thread_id", "food_name").agg(F.min("turn").alias("first_turn"))
    start = turns.groupBy("thread_id").agg(F.min("turn").alias("t0"))
    j = names.join(first, ["thread_id", "food_name"]).join(start, "thread_id").where(F.col("turn") > F.col("t0"))
    per_turn = j.groupBy("thread_id", "turn").agg((F.sum((F.col("first_turn") < F.col("turn")).cast("int")) / F.count(F.lit(1))).alias("overlap"))
    return per_turn.groupBy("thread_id").agg(F.avg("overlap").alias("mean_overlap"), (F.lit(1.0) - F.stddev_pop("overlap")).alias("retention"))


def rag_aggregate(top: DataFrame, terms: DataFrame, times: DataFrame, k: int = 5) -> DataFrame:
    """Per back-end the means over its queries of relevance, response
    time, context usage and keyword coverage; the winner has the greatest
    relevance x coverage.

    ``top``: backend, qid, rank, food_name, category, similarity of the first
    k rows; ``terms``: qid, terms; ``times``: backend, qid, response_ms. The
    answer of a back-end is the context of the other one (V20); a query's k
    rows are one row from the first aggregation on.
    """
    line = F.format_string("- %s (category %s)", F.col("food_name"), F.col("category").cast("string"))
    per = top.where(F.col("rank") <= k).groupBy("backend", "qid").agg(
        F.avg("similarity").alias("relevance"), F.collect_list("food_name").alias("names"),
        F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_l"))
    per = per.withColumn("context", F.array_join(F.col("_l.l"), "\n")).drop("_l")
    answer = per.select(F.col("backend").alias("_of"), "qid", F.col("context").alias("answer"))
    j = per.join(answer, "qid").where(F.col("_of") != F.col("backend")).join(terms, "qid").join(times, ["backend", "qid"])
    hits = F.size(F.filter(F.array_distinct("names"), lambda n: F.exists("terms", lambda t: F.contains(F.lower(n), t))))
    scored = j.select("backend", "relevance", "response_ms", share_found(F.col("answer"), F.col("names")).alias("usage"), (hits / k).alias("coverage"))
    s = scored.groupBy("backend").agg(*[F.avg(c).alias(c) for c in ("relevance", "response_ms", "usage", "coverage")])
    s = s.withColumn("score", F.col("relevance") * F.col("coverage"))
    best = s.agg(F.max_by("backend", F.struct("score", "backend")).alias("winner"))  # one row
    return s.crossJoin(F.broadcast(best)).withColumn("is_winner", F.col("backend") == F.col("winner")).drop("winner")


def embed_with(texts: DataFrame, id_col: str, text_col: str, fn, dim: int) -> DataFrame:
    """V18 plug point: embed texts with a caller-supplied vectorized function
    ``fn(pandas.Series[str]) -> array-like of shape (n, dim)`` (for example a
    local ONNX model). Runs per Arrow batch with ``mapInPandas``; the batch
    size is ``spark.sql.execution.arrow.maxRecordsPerBatch``, so memory per
    task stays bounded whatever the table size."""
    import numpy as np

    from larder.session import ship_package
    ship_package(texts.sparkSession)

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(fn(pdf[text_col]), dtype="float32").reshape(len(pdf), dim)
            out = pdf[[id_col]].copy()
            out["embedding"] = list(vecs)
            yield out

    id_type = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")
