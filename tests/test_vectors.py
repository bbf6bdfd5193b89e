import numpy as np
from pyspark.sql import functions as F

from larder.functions import vector as vf
from larder.operators import common as cm
from larder.operators import evals as ev
from larder.operators import vectors as vx


def _vectors(spark, n=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype("float32")
    rows = [(i, f"food {i % 7}", i % 4, [float(x) for x in data[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "fdc_id long, food_name string, category int, embedding array<float>"), data


def test_cosine_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vf.cosine("a", "b")).collect()]
    assert got[0] is None and abs(got[1] - 1.0) < 1e-12


def test_topk_batch_matches_brute_force(spark):
    v, data = _vectors(spark)
    rng = np.random.default_rng(9)
    qs = rng.normal(size=(5, data.shape[1]))
    qdf = spark.createDataFrame([(i, [float(x) for x in qs[i]]) for i in range(5)], "qid long, qvec array<double>")
    for block in (1024, 2):   # one block sent to all tasks, and a table of blocks
        res = vx.vector_topk_batch(v, qdf, 3, block=block)
        got = {}
        for r in res.collect():
            got.setdefault(r.qid, []).append((r.rank, r.fdc_id))
        d = data.astype("float64")
        for i in range(5):
            sims = d @ qs[i] / (np.linalg.norm(d, axis=1) * np.linalg.norm(qs[i]))
            want = sorted(range(len(d)), key=lambda j: (-sims[j], j))[:3]
            assert [f for _, f in sorted(got[i])] == want


def test_intra_category_similarity_without_pairs(spark):
    v, data = _vectors(spark, n=60)
    got = {r.category: r.avg_similarity for r in vx.intra_category_similarity(v, first_n=10).collect()}
    d = data.astype("float64")
    for c in range(4):
        idx = [i for i in range(60) if i % 4 == c][:10]
        u = d[idx] / np.linalg.norm(d[idx], axis=1, keepdims=True)
        sims = [u[a] @ u[b] for a in range(10) for b in range(a + 1, 10)]
        assert abs(got[c] - np.mean(sims)) < 1e-9


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = cm.global_index(df, ["k"], n_parts=7)
    got = sorted((r.row_index, r.k) for r in idx.collect())
    assert got == [(i + 1, i) for i in range(1000)]


def test_global_index_large_sampled_layout(spark):
    n = 200_000
    df = spark.range(0, n).select(((F.col("id") * 7919) % n).alias("k"))
    idx = cm.global_index(df, ["k"], n_parts=16)
    bad = idx.where(F.col("row_index") != F.col("k") + 1).count()
    assert bad == 0 and idx.count() == n


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=301)
    df = spark.createDataFrame([(int(i % 3), float(x), i) for i, x in enumerate(vals)], "g int, v double, id long")
    got = {(r.g, r.q): r.value for r in cm.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0], "id").collect()}
    for g in range(3):
        xs = vals[[i for i in range(301) if i % 3 == g]]
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert abs(got[(g, q)] - np.percentile(xs, q * 100)) < 1e-12


def test_exact_quantiles_by_many_passes(spark, monkeypatch):
    """Heavy tails, ties and one value only, with brackets so small that several passes are due."""
    monkeypatch.setattr(cm, "QUANTILE_CELLS", 100)
    monkeypatch.setattr(cm, "QUANTILE_ROWS", 20)
    rng = np.random.default_rng(6)
    groups = {"tail": np.exp(rng.normal(size=400) * 5), "ties": rng.integers(0, 3, 500).astype(float), "same": np.full(50, 2.5), "one": np.array([7.0]),
              "mixed": np.append(rng.normal(size=100), np.full(300, 0.25))}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("tail", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in cm.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {(g, q) for g in groups for q in probs}
    for (g, q), v in got.items():
        assert abs(v - np.percentile(groups[g], q * 100)) <= 1e-12 * max(1.0, abs(v)), (g, q)
    assert cm.exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_ttest_p_value(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1.0, 1.0, 40), rng.normal(1.4, 1.0, 50)
    df = spark.createDataFrame([("A", float(x)) for x in a] + [("B", float(x)) for x in b], "g string, v double")
    r = ev.latency_ttest(df, "g", "v", "A", "B").first()
    n1, n2 = len(a), len(b)
    sp = ((n1 - 1) * a.var(ddof=1) + (n2 - 1) * b.var(ddof=1)) / (n1 + n2 - 2)
    t = (a.mean() - b.mean()) / np.sqrt(sp * (1 / n1 + 1 / n2))
    assert abs(r.t_statistic - t) < 1e-9 and r.dof == 88
    assert 0 < r.p_value < 1
    d = abs(a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2)
    assert abs(r.cohens_d - d) < 1e-9


def test_embed_with_plug_point(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, "ccc")], "id long, t string")

    def fn(s):
        return np.stack([[len(x), x.count(" ")] for x in s])
    got = sorted((r.id, list(r.embedding)) for r in vx.embed_with(df, "id", "t", fn, 2).collect())
    assert got == [(1, [4.0, 1.0]), (2, [3.0, 0.0])]


def test_context_size_choice_and_diversity_brute_force(spark):
    v, data = _vectors(spark, n=80)
    v = v.withColumn("food_type", (F.col("fdc_id") % 5).cast("string"))
    rng = np.random.default_rng(11)
    qs = rng.normal(size=(3, data.shape[1]))
    qdf = spark.createDataFrame([(i, [float(x) for x in qs[i]]) for i in range(3)], "qid long, qvec array<double>")
    res = vx.vector_topk_batch(v, qdf, 20)
    choice = {r.qid: (r.best_k, r.best_score) for r in vx.context_size_choice(res).collect()}
    div = {r.qid: r.diversity for r in vx.result_diversity(res, 20).collect()}
    d = data.astype("float64")
    for i in range(3):
        sims = d @ qs[i] / (np.linalg.norm(d, axis=1) * np.linalg.norm(qs[i]))
        order = sorted(range(len(d)), key=lambda j: (-sims[j], j))
        scores = []
        for k in (3, 5, 10, 20):
            top = order[:k]
            scores.append((0.7 * np.mean(sims[top]) + 0.3 * len({j % 5 for j in top}) / k, k))
        best = max(scores, key=lambda x: (x[0], -x[1]))
        assert choice[i][0] == best[1] and abs(choice[i][1] - best[0]) < 1e-9
        assert abs(div[i] - len({j % 5 for j in order[:20]}) / 20) < 1e-12


def test_hash_embedding_keeps_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, "apple pie"), (2, "!!!"), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r.embedding for r in vx.hash_embedding(df, "text", "id", 16).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert abs(np.linalg.norm(got[1]) - 1.0) < 1e-12
    assert got[2] == got[3] == got[4] == [0.0] * 16


def test_topk_batch_edge_cases(spark):
    """Zero, NULL, short and NULL-holding vectors rank last by id; equal
    vectors go by id; both ways agree, whatever the size of a block."""
    rows = [(5, "a", [1.0, 0.0]), (3, "b", [2.0, 0.0]), (9, "c", [0.0, 0.0]), (8, "d", None), (7, "e", [1.0]), (6, "f", [None, 1.0]),
            (2, "g", [-1.0, 0.5]), (3, "b", [2.0, 0.0])]
    v = spark.createDataFrame(rows, "fdc_id long, food_name string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([("x", [3.0, 0.0]), ("y", [0.0, 0.0]), ("z", None), ("w", [1.0, 2.0, 3.0]), (None, [0.0, 1.0])], "qid string, qvec array<double>")

    def got(block):
        return sorted(((r.qid, r.rank, r.fdc_id, r.food_name, None if r.similarity is None else round(r.similarity, 9))
                       for r in vx.vector_topk_batch(v, q, 7, block=block).collect()), key=str)
    one = got(10)
    assert one == got(5) == got(4) == got(1)
    x = [r[2:] for r in sorted((r for r in one if r[0] == "x"), key=lambda r: r[1])]
    assert x == [(3, "b", 1.0), (3, "b", 1.0), (5, "a", 1.0), (2, "g", round(-1 / 1.25 ** 0.5, 9)), (6, "f", None), (7, "e", None), (8, "d", None)]
    assert [r[2] for r in one if r[0] == "y"] == [2, 3, 3, 5, 6, 7, 8] and all(r[4] is None for r in one if r[0] in ("y", "z", "w"))
    assert vx.vector_topk_batch(v.limit(0), q, 2).count() == 0
    assert vx.vector_topk_batch(v, q.limit(0), 2).count() == 0


def test_topk_batch_many_queries_few_vectors(spark, monkeypatch):
    """Queries stay where they are: none is copied to every part, and what the
    two other ways give comes out, ties of more than a piece included."""
    from larder.functions import blockscore
    monkeypatch.setattr(blockscore, "ROWS", 4)
    monkeypatch.setattr(blockscore, "QUERIES", 16)
    rng = np.random.default_rng(3)
    rows = [(i, f"f{i}", None if i == 5 else [0.0, 0.0] if i == 6 else [1.0, 1.0] if i > 12 else rng.integers(-2, 3, 2).astype(float).tolist()) for i in range(24)]
    v = spark.createDataFrame(rows, "fdc_id long, food_name string, embedding array<double>").repartition(3)
    asked = [(i, None if i == 7 else rng.integers(-2, 3, 2).astype(float).tolist()) for i in range(60)] + [(3, [1.0, 0.5]), (None, [0.0, 1.0])]
    q = spark.createDataFrame(asked, "qid long, qvec array<double>").repartition(3)

    def got(df):
        return sorted(((r.qid, r.rank, r.fdc_id, r.food_name, None if r.similarity is None else round(r.similarity, 9)) for r in df.collect()), key=str)
    few = vx.vector_topk_batch(v, q, 3, block=30)
    assert "Generate" not in few._jdf.queryExecution().toString()
    assert got(few) == got(vx.vector_topk_batch(v, q, 3, block=100)) == got(vx.vector_topk_batch(v, q, 3, block=8))
    assert len(got(few)) == 3 * 61
    assert vx.vector_topk_batch(v.limit(0), q, 3, block=30).count() == 0


def test_parts_go_by_the_vectors():
    """Every query is copied to each part: more blocks of queries than tasks leave one part."""
    assert [vx._parts(1000, b, 600) for b in (1, 2, 250, 700)] == [600, 300, 3, 1]
    assert vx._parts(10 * vx.PART_ROWS, 700, 600) == 10


def test_topk_batch_many_ties_in_one_batch(spark, monkeypatch):
    """More equal vectors than a chunk holds: the smallest ids win."""
    from larder.functions import blockscore
    monkeypatch.setattr(blockscore, "ROWS", 16)
    import pyarrow as pa
    best = blockscore.BlockTopK(pa.array([1, 2]), pa.array([[1.0, 0.0], [0.6, 0.8]]), 3)
    ids = np.random.default_rng(1).permutation(500)
    for a in range(0, 500, 100):
        best.add(pa.RecordBatch.from_arrays([pa.array(ids[a:a + 100]), pa.array([[0.5, 0.5]] * 100)], ["id", "vec"]))
    out = next(best.results()).to_pylist()
    assert sorted((r["qid"], r["id"]) for r in out) == [(q, i) for q in (1, 2) for i in range(3)]


def test_plan_size_is_free_of_the_query_count(spark):
    import time
    v, _ = _vectors(spark, n=30)

    def plan_of(n):
        q = spark.range(n).select(F.col("id").alias("qid"), F.array(*[F.rand(i) for i in range(8)]).alias("qvec"))
        started = time.time()
        df = vx.vector_topk_batch(v, q, 2)
        plan = df._jdf.queryExecution().toString()
        return df, len(plan), time.time() - started
    few, size, _ = plan_of(5000)
    assert few.groupBy("qid").count().where("count = 2").count() == 5000
    _, many_size, seconds = plan_of(262_144)
    assert many_size < size * 1.1 and seconds < 30


def test_running_totals(spark):
    """A key with two thirds of the rows runs over several partitions."""
    rng = np.random.default_rng(7)
    rows = [(None if k == 0 else int(k) if k < 5 else 5, i, int(x), -int(x)) for i, (k, x) in enumerate(zip(rng.integers(0, 15, 900), rng.integers(0, 100, 900)))]
    df = spark.createDataFrame(rows, "k long, t long, a long, b long").repartition(5)
    got = {(r.k, r.t): (r.a, r.b) for r in cm.running_totals(df, ["k"], ["t"], ["a", "b"], n_parts=6).collect()}
    sums, exp = {}, {}
    for k, t, a, b in rows:
        s = sums.get(k, (0, 0))
        sums[k] = exp[k, t] = s[0] + a, s[1] + b
    assert got == exp
    assert cm.running_totals(df.limit(0), ["k"], ["t"], ["a"]).count() == 0


def test_context_retention_brute_force(spark):
    """The scanned counts give what the joined texts give, for a thread that is longer than a range."""
    rng = np.random.default_rng(5)
    words = "oats milk rice beans egg kale fig nut soy corn".split()
    foods = [(i, f"f{i % 9}", " ".join(rng.choice(words, 4))) for i in range(25)]
    turns = [(t, i, None if i == 3 else " ".join(rng.choice(words, 2))) for t, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    f = spark.createDataFrame(foods, "fdc_id long, food_name string, embedding_text string")
    m = spark.createDataFrame(turns, "thread_id long, turn long, content string")
    got = {r.thread_id: (r.mean_overlap, r.retention) for r in vx.context_retention(m, f, dim=16).collect()}
    joined = [(f"{t}:{i}", " ".join(x or "" for a, b, x in turns if a == t and b <= i)) for t, i, _ in turns]
    emb = {r.id: np.array(r.embedding) for r in vx.hash_embedding(spark.createDataFrame(joined, "id string, text string"), "text", "id", 16).collect()}
    femb = {r.fdc_id: np.array(r.embedding) for r in vx.hash_embedding(f, "embedding_text", "fdc_id", 16).collect()}
    seen, exp = {}, {}
    for t, i, _ in turns:
        sims = sorted(((-round(float(emb[f"{t}:{i}"] @ femb[k]), 9) if emb[f"{t}:{i}"].any() and femb[k].any() else 9, k, n) for k, n, _ in foods))[:3]
        names = {n for _, _, n in sims}
        if t in seen:
            exp.setdefault(t, []).append(len(names & seen[t]) / len(names))
        seen[t] = seen.get(t, set()) | names
    assert set(got) == set(exp) == {1, 2}
    for t, x in exp.items():
        assert abs(got[t][0] - np.mean(x)) < 1e-9 and abs(got[t][1] - (1 - np.std(x))) < 1e-9


def test_context_retention_scores_once(spark, monkeypatch):
    """The retrieved rows are read twice, but scored once."""
    m = spark.createDataFrame([(t, i, w) for t in range(3) for i, w in enumerate(("oats", "milk", "oats rice"))], "thread_id long, turn long, content string")
    f = spark.createDataFrame([(i, f"f{i}", w) for i, w in enumerate(("oats", "milk", "rice"))], "fdc_id long, food_name string, embedding_text string")
    seen, topk = spark.sparkContext.accumulator(0), vx.vector_topk_batch

    def counting(v, q, k):
        top = topk(v, q, k)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return top.mapInArrow(count, top.schema)
    monkeypatch.setattr(vx, "vector_topk_batch", counting)
    assert vx.context_retention(m, f, dim=16).count() == 3
    assert seen.value == 9 * 3
