"""The pipeline's stages against plain Python."""

from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from larder.llm import chosen_path, mixing
from tests.llm import brute


@pytest.fixture
def texts_near():
    first, third = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    edited = list(third)
    for i in range(20, 200, 40):
        edited[i] = f"edit{i}"
    return {1: " ".join(first), 2: " ".join(first + [f"more{i}" for i in range(44)]), 3: " ".join(third), 4: " ".join(edited)}


def near_groups(texts, n, percent):
    sets = {k: brute.shingles(t, n) for k, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b])]
    return brute.groups(sorted(sets), links)


def test_near_dedup_at_five_words_and_80(spark, texts_near):
    """A copy with a block appended goes, one with scattered edits stays."""
    at_5, at_3 = near_groups(texts_near, 5, 80), near_groups(texts_near, 3, 85)
    assert at_5[2] == 1 and at_3[2] == 2 and at_5[4] == 4 and at_3[4] == 3
    docs = spark.createDataFrame([*texts_near.items(), (None, texts_near[1])], "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([k for k, v in at_5.items() if k == v] + [None], key=str)
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()}
    assert {k: got[k] for k in texts_near} == at_3


def test_sketches_lose_no_pair_at_the_threshold():
    assert chosen_path.least_agreeing(85) == 17
    assert chosen_path.least_agreeing(80) < 17
    for percent in (50, 80, 85, 95):
        k, same = chosen_path.least_agreeing(percent), percent / 100 + (1 - percent / 100) / 16
        assert sum(brute_binomial(32, j, same) for j in range(k)) <= 2e-6 < sum(brute_binomial(32, j, same) for j in range(k + 1))


def brute_binomial(n, k, p):
    out = 1.0
    for j in range(k):
        out *= (n - j) / (j + 1) * p
    return out * (1 - p)**(n - k)


def test_mixed_documents_keep_the_copies_of_each_row(spark):
    """Rows without an id and rows that repeat one get what mix() gave each."""
    rows = [(None, f"n{i} " * 10, "b") for i in range(40)] + [(i % 25, f"w{i} " * (10 + i % 3), s) for s in "ac" for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    judged, left = mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()
    exp = Counter()
    for r in judged:
        exp[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in left)
    assert got == +exp and any(k[0] is None for k in got)
    assert {r.copies for r in judged if r.source == "b"} == {0, 1}
    assert max(Counter((r.source, r.text) for r in left).values()) <= 2
    assert sum(len(r.text.split()) for r in left) == sum(r.taken for r in judged)
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, left))
