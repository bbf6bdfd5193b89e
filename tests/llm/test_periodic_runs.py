"""Runs of words against a search over every start and period."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import periodic_runs
from tests.llm import brute


def _runs(lists, least=12):
    ids = np.concatenate([np.array([ord(c) + 1000 * k for c in w], np.int64) for k, w in enumerate(lists)] + [np.zeros(0, np.int64)])
    offs = np.append(0, np.cumsum([len(w) for w in lists])).astype(np.int64)
    start, length, period = periodic_runs.runs(ids, offs, least)
    own = np.searchsorted(offs, start, "right") - 1
    return [[(int(s - offs[k]), int(m), int(q)) for s, m, q, o in zip(start, length, period, own) if o == k] for k in range(len(lists))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4), st.sampled_from([1, 2, 5, 12]))
def test_runs_of_random_words(lists, least):
    assert _runs(lists, least) == [brute.runs(w, least) for w in lists]


def test_runs_of_known_words():
    nested = ("ab" * 6 + "c") * 4
    fib = "a", "ab"
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    for w in ("", "a", "a" * 11, "a" * 12, "a" * 500, "abc" * 4, "abc" * 30 + "x" + "abc" * 30, nested, fib[1]):
        assert _runs([w]) == [brute.runs(w)], w


def test_repeats_in_different_texts_are_no_runs():
    assert _runs(["abcdefghijkl", "abcdefghijkl"]) == [[], []]


def test_periodic_runs(docs, no_docs, rows):
    found = periodic_runs.planted(docs)
    assert found.columns == ["doc_id", "text"]
    got = {}
    for r in periodic_runs.periodic_runs(found).collect():
        x = [tuple(y) for y in r.runs], r.kept, r.n_words
        assert got.setdefault(r.doc_id, x) == x
    digests = {r.doc_id: r for r in periodic_runs.summary(periodic_runs.periodic_runs(found)).collect()}
    assert len(got) == len({r[0] for r in rows})
    some = 0
    for r in rows:
        if r[0] == 61:  # 8,000 random words: the plain search takes too long; see test_long_text
            continue
        w = brute.periodic(r[0], brute.words(r[1]))
        x = brute.runs(w)
        gone = {i for s, m, q in x for i in range(s + q, s + m)}
        kept = " ".join(v for i, v in enumerate(w) if i not in gone)
        assert got[r[0]] == (x, kept, len(w)), r[0]
        d = digests[r[0]]
        some += bool(x)
        best = min(x, key=lambda y: (-y[1], y[0], y[2])) if x else None
        assert (d.n_runs, d.start, d.length, d.period) == (len(x), *(best or (None,) * 3))
        assert d.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert d.runs_sha256 == brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in x))
        assert d.collapsed_sha256 == brute.sha(kept)
    assert some > 3
    assert periodic_runs.periodic_runs(no_docs).count() == 0


@pytest.mark.parametrize("period", [1, 7, 3000])
def test_long_text(spark, period):
    rng = random.Random(1)
    own = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    cycle = [f"c{i}" for i in range(period)]
    text = " ".join(own + cycle * (60_000 // period) + ["end"])
    df = spark.createDataFrame([("x", text), ("y", "")], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert [tuple(r) for r in got["x"].runs] == [(2000, 60_000 // period * period, period)]
    assert got["x"].kept == " ".join(own + cycle + ["end"])
    assert (got["y"].runs, got["y"].kept, got["y"].n_words) == ([], "", 0)
