"""Every operator on the fixture against plain Python, and on an empty table."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm import brute
from larder.llm import chosen_path, doubling, line_crf, line_runs, mixing, packing, rules, secrets, toxicity, winnowing


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] for r in rows if r[0] is not None}


def by_id(df):
    """Rows by id; repeated rows of an id must be equal."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r
    return out


def test_rules(docs, no_docs, rows):
    got = by_id(rules.quality_rules(docs))
    assert len(got) == len({r[0] for r in rows})
    for r in rows:
        g = got[r[0]]
        n, chars, symbols, dup, rep = brute.base_counts(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, rep), r[0]
        assert g.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (g.base_failed and g.kept)
        assert g.word_distance is None or (n >= rules.MIN_WORDS and r[2] in rules.COMMON_WORDS)
    kept = rules.accepted_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.kept}
    assert rules.quality_rules(no_docs).count() == 0 and rules.accepted_documents(no_docs).count() == 0


def test_rules_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 5.0]), ([1.0, 1.0], [3.0, 1.0])], "p array<double>, q array<double>")
    p, q = (0.5, 0.5), (0.75, 0.25)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    div = sum(a * math.log2(a / c) for a, c in zip(p, m)) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m)) / 2
    got = [r[0] for r in df.select(rules.distance(df.p, df.q)).collect()]
    assert got == pytest.approx([0.0, 1.0, math.sqrt(div)])


def test_chosen_path(docs, no_docs, texts):
    sizes, comp = brute.components(texts)
    got = by_id(chosen_path.near_duplicates(docs))
    for k in texts:
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (sizes[k], comp[k], comp[k] == k), k
    assert got[None].component_id is None and got[None].kept
    assert any(v != k for k, v in comp.items())
    left = chosen_path.one_of_each_group(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k in texts if comp[k] == k} | {None}
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_chosen_path_large_nodes(spark, monkeypatch):
    """A group larger than a small node whose links form a star, and chains."""
    monkeypatch.setattr(chosen_path, "SMALL", 24)
    monkeypatch.setattr(chosen_path, "LEVELS", 2)
    monkeypatch.setattr(chosen_path, "TREES", 6)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = {0: " ".join(base)}
    for k in range(1, 90):
        edited = list(base)
        for i in rng.choice(300, 5 + k % 9, replace=False):
            edited[i] = f"edit{k}_{i}"
        texts[k] = " ".join(edited)
    # a chain: each takes the place of six more words, so that far ones are no longer alike
    for k in range(90, 130):
        texts[k] = " ".join(f"c{i}" for i in range(6 * (k - 90), 6 * (k - 90) + 200))
    _, comp = brute.components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(df).collect()} == comp


def test_line_runs(docs, no_docs, texts):
    exp = brute.without_lines(texts)
    got = by_id(line_runs.line_dedup(docs).where("doc_id is not null"))
    for k, (n, gone, kept) in exp.items():
        assert (got[k].n_lines, got[k].n_removed, got[k].kept) == (n, gone, kept), k
    assert sum(g for _, g, _ in exp.values()) > 5
    left = line_runs.deduplicated_documents(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} - {None} == {k for k, (_, g, t) in exp.items() if not g or brute.words(t)}
    assert line_runs.line_dedup(no_docs).count() == 0


def test_line_runs_longest(spark):
    run = "\n".join(f"line {i}" for i in range(20))
    df = spark.createDataFrame([(1, run), (2, "own first line\n" + run + "\nown last"), (3, "nothing like it")], "doc_id long, text string")
    got = {r["_row"]["doc_id"]: (r["_n_removed"], r["_copied_run"]) for r in line_runs.without_later_copies(df).collect()}
    assert got == {1: (0, 0), 2: (20, 16), 3: (0, 0)}


def test_secrets(docs, no_docs, rows):
    got = by_id(secrets.findings(docs))
    kinds = [r.kind for r in secrets.RULES]
    for r in rows:
        spans = brute.base_spans(r[1])
        g = got[r[0]]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3)), r[0]
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert g.base_sha256 == brute.sha(joined)
        assert set(filter(None, joined.split(","))) <= set(g.spans.split(","))
    assert got[62].n_assign == 2 and got[63].n_access == 1 and got[63].n_hex == 2
    assert secrets.findings(no_docs).count() == 0


def test_secrets_ledger(spark, docs):
    """A second run scans only what the ledger lacks, and finds the same."""
    first, _ = secrets.scan(docs, rules=secrets.BASE)
    assert first.select("blob").distinct().count() == first.count() == docs.select("text").na.fill("").distinct().count()
    second, _ = secrets.scan(docs, ledger=first)
    assert {r.version for r in second.select("version").distinct().collect()} == {2} and second.count() == first.count()
    third, _ = secrets.scan(docs, ledger=first.unionByName(second))
    assert third.count() == 0
    whole = {r.doc_id: r for r in secrets.findings(docs).collect()}
    assert {r.doc_id: r for r in secrets.findings(docs, ledger=first).collect()} == whole


def test_added_secrets(spark):
    text = "é -----BEGIN RSA PRIVATE KEY----- x postgres://user:pw@db.example.com y"
    r = secrets.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r.spans == f"pem:2:33,login:{text.index('postgres')}:{text.index(' y')}" and r.n_assign == 0


def test_doubling(docs, no_docs, texts):
    exp = brute.without_windows(texts)
    got = by_id(doubling.substring_dedup(docs))
    for k, (n, gone, kept) in exp.items():
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, gone, brute.sha(kept)), k
    assert got[None].n_removed == 0 and sum(g for _, g, _ in exp.values()) > 100
    assert doubling.substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("rows_at_once", [7, 2_000_000])
def test_doubling_inside_and_across(spark, rows_at_once, monkeypatch):
    """Repeats inside a document, across, overlapping, and in small portions."""
    monkeypatch.setattr(doubling, "ROWS", rows_at_once)
    rng = np.random.default_rng(2)
    run = [f"r{i}" for i in range(45)]
    texts = {k: " ".join([f"u{k}_{i}" for i in range(rng.integers(0, 30))] + run[rng.integers(0, 10):rng.integers(25, 45)] * (1 + k % 3)) for k in range(40)}
    exp = brute.without_windows(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in doubling.substring_dedup(df).collect()}
    assert got == {k: (n, g, brute.sha(t)) for k, (n, g, t) in exp.items()}


def test_doubling_rows_of_one_id(spark):
    """Each text of an id loses its own words only, and each repeats the other's."""
    run, other = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("r", 30), ("o", 60))]
    rows = [(1, run), (2, "two words " + run), (2, other), (3, "x " + other), (3, "x " + other), (None, run), (4, other), (4, run + " y")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in doubling.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (2, 32, 30), (2, 60, 0), (3, 61, 60), (3, 61, 60), (4, 31, 30), (4, 60, 60)]


def test_doubling_ids_that_are_strings(spark):
    run = " ".join(f"r{i}" for i in range(25))
    df = spark.createDataFrame([("b", run), ("a10", "x " + run), ("a9", run + " y"), (None, run), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in doubling.substring_dedup(df).collect()}
    assert got == {"a10": (26, 0), "a9": (26, 25), "b": (25, 25), None: (25, 0), "c": (0, 0)}


def test_winnowing(docs, no_docs, rows):
    got = by_id(winnowing.edited_fingerprints(docs))
    texts = {r[0]: r[1] or "" for r in rows}
    ids = sorted(texts, key=lambda k: (k is not None, k))
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, u, g = texts[a], texts[b], got[a]
        if len(t) > 20_000:
            continue
        n = len(t)
        edited = t[:n - n // 2] + u[:n // 2]
        x, y, z = brute.marks(t), brute.marks(edited), brute.marks(u)
        assert (g.n_chars, g.edited_sha256) == (n, brute.sha(edited))
        assert g.fingerprint == ",".join(f"{j}:{h}" for h, j in x) and g.edited_fingerprint == ",".join(f"{j}:{h}" for h, j in y)
        assert (g.near_edited, g.near_next) == (pytest.approx(brute.likeness(x, y)), pytest.approx(brute.likeness(x, z)))
    assert winnowing.edited_fingerprints(no_docs).count() == 0


def test_winnowing_guarantee(spark):
    """A shared run of w + k - 1 words leaves a shared mark."""
    rng = np.random.default_rng(4)
    run = " ".join(f"s{i}" for i in range(winnowing.W + winnowing.K - 1))
    rows = [(k, " ".join(f"a{k}_{i}" for i in range(rng.integers(0, 40))) + " " + run + " " + " ".join(f"b{k}_{i}" for i in range(rng.integers(0, 40))))
            for k in range(30)]
    df = winnowing.with_marks(spark.createDataFrame(rows, "doc_id long, text string"), "text", "marks")
    sets = [{m >> 32 for m in r.marks} for r in df.collect()]
    assert set.intersection(*sets)


def test_mixing(docs, no_docs, rows):
    sized = [(r[0], r[3], len(brute.words(r[1]))) for r in rows]
    target, sizes = brute.mix(sized)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * max(n for _, x, n in sized if x == s) + 1, s
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = str(public.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    return path, lambda text: plain.encode(text, add_special_tokens=False).ids


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftext| >", "word " * 30_000 + "<|endoftext|> more"]


def test_ids_of_special_tokens(tokenizer):
    """What the vocabulary adds is one id wherever a text spells it."""
    encode = packing._tokenizer(tokenizer[0])
    assert tokenizer[1](SPECIAL[0]) == [64, 220, 50256, 275]
    for text in SPECIAL:
        assert [i for p in packing._parts(text) for i in encode(p)] == tokenizer[1](text)


def test_packing(spark, docs, no_docs, rows, tokenizer):
    plain = tokenizer[1]
    some = [(500 + k, t) for k, t in enumerate(SPECIAL)]
    docs = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*r, "x") for r in some], "doc_id long, text string, score string"))
    rows = [*rows, *some]
    exp = defaultdict(int)
    for r in rows:
        ids = np.array([*plain(r[1] or ""), 0], "<u4")
        first, a = (len(ids) - 1) % 2048 + 1, 0
        for j, b in enumerate(range(first, len(ids) + 1, 2048)):
            exp[r[0], j, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            a = b
    got, sequences = defaultdict(int), defaultdict(list)
    for r in packing.pack(docs, tokenizer[0]).collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == exp
    for places in sequences.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(k[3] * n for k, n in exp.items())
    assert len(sequences) <= math.ceil(total / 2048) + 1
    assert packing.pack(no_docs, tokenizer[0]).count() == 0


def test_packing_long_text_in_parts(tokenizer, monkeypatch):
    text = "Don't stop me now, he'll say 12345 times \n\n  ok?" * 50
    whole = tokenizer[1](text)
    monkeypatch.setattr(packing, "CHUNK", 40)
    encode = packing._tokenizer(tokenizer[0])
    parts = list(packing._parts(text))
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in encode(p)] == whole


@pytest.mark.parametrize("n", [0, 1, 60, 5000])
def test_packing_plan(n):
    rng = np.random.default_rng(n)
    sizes = np.clip(rng.lognormal(3.5, 1, n).astype(int), 1, 256)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(sizes, return_counts=True))}
    used = defaultdict(int)
    plan = packing.plan(histogram, 256, 40)
    for contents, number in plan:
        assert sum(s * a for s, a in contents) <= 256
        for s, a in contents:
            used[s] += a * number
    assert used == histogram
    assert sum(number for _, number in plan) <= math.ceil(sizes.sum() / 256 * 1.01) + 1


def test_knapsack():
    sizes, prices = np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0])
    worth, config = packing.best_configuration(prices, sizes, 13)
    assert worth == 18.0 and sum(sizes[k] * a for k, a in config.items()) <= 13


@pytest.mark.parametrize("operator", [line_crf.quality, toxicity.toxicity])
def test_classifiers_take_all_rows(spark, docs, no_docs, labels, rows, operator):
    got = operator(docs, labels).collect()
    assert len(got) == len(rows)
    parts, part = (5, 0) if operator is line_crf.quality else (4, 2)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part)
    assert operator(no_docs, labels).count() == 0
    blank = operator(docs, labels.where("false")).collect()
    assert {r.score for r in blank} == {0.5}


def test_classifiers_ignore_held_out_labels(docs, labels):
    from pyspark.sql import functions as F
    for operator, col, parts, part in ((line_crf.quality, "quality", 5, 0), (toxicity.toxicity, "toxic", 4, 2)):
        flipped = labels.withColumn(col, F.when(toxicity.held_out_at(parts, part), 1 - F.col(col)).otherwise(F.col(col)))
        assert sorted(map(str, operator(docs, labels).collect())) == sorted(map(str, operator(docs, flipped).collect()))


def test_crf_marginals():
    """Forward-backward equals the sum over all labellings."""
    rng = np.random.default_rng(1)
    sizes = [4, 1, 3]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    unary, stay = rng.normal(size=8), rng.normal(size=(2, 2))
    got = line_crf.marginals(unary, ptr, stay)
    for a, n in zip(ptr, sizes):
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = math.exp(sum(unary[a + i] * y[i] for i in range(n)) + sum(stay[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert got[a:a + n] == pytest.approx(good / total)


def test_crf_lines():
    text = ["a b.\nC!\n", "", "\n", "x"]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    x, ptr, size = line_crf.line_features(data, offs)
    assert ptr.tolist() == [0, 3, 4, 6, 7] and size.tolist() == [4, 2, 0, 0, 0, 0, 1]
    own = line_crf.N_OWN
    assert (x[1:3, own:2 * own] == x[0:2, :own]).all() and not x[0, own:2 * own].any() and not x[3, own:3 * own].any()


@pytest.mark.parametrize("name, col, parts, part", [("quality", "quality", 5, 0), ("toxicity", "toxic", 4, 2)])
def test_held_out_accuracy(spark, name, col, parts, part):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    operator = line_crf.quality if name == "quality" else toxicity.toxicity
    pairs = [(r.score, r[col]) for r in operator(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > (0.95 if name == "quality" else 0.75), auc


def test_chosen_path_id_with_two_texts(spark):
    """No pair is alike, yet an id with two texts is one document."""
    rows = [(2, "a b c d e f g"), (2, "h i j k l m n"), (1, "h i j k l m n"), (3, "o p q r s t u"), (3, None)]
    got = {r.doc_id: (r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
