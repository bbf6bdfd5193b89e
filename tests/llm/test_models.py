"""The trained operators against plain loops."""

import math
import re

import numpy as np
import pytest

from larder.llm import line_crf, toxicity


def _log_likelihood(x, ptr, y, w, stay):
    """By brute force over all labellings of every text."""
    out = 0.0
    counts = [max(int((y == k).sum()), 1) for k in (0, 1)]
    for a, b, label in zip(ptr, ptr[1:], y):
        def score(labels):
            return sum(float(x[a + i] @ w) * v for i, v in enumerate(labels)) + sum(stay[u, v] for u, v in zip(labels, labels[1:]))
        n = b - a
        total = math.log(sum(math.exp(score([code >> i & 1 for i in range(n)])) for code in range(2**n)))
        out += (score([int(label)] * n) - total) / counts[int(label)] / 2 / n
    return out - line_crf.PENALTY / 2 * (float(w @ w) + float((stay * stay).sum()))


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_crf_fit_climbs_to_the_maximum(monkeypatch, block):
    """At the weights that ``fit`` returns, no direction raises the likelihood, however the texts are cut into blocks."""
    monkeypatch.setattr(line_crf, "BLOCK", block)
    rng = np.random.default_rng(3)
    sizes = [3, 1, 4, 2, 2, 5]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    x, y = rng.normal(size=(ptr[-1], 3)).astype(np.float32), np.array([0, 1, 1, 0, 1, 0])
    w, stay = line_crf.fit(x, ptr, y, 60)
    best = _log_likelihood(x, ptr, y, w, stay)
    assert best > _log_likelihood(x, ptr, y, np.zeros(3), np.zeros((2, 2))) + 0.05
    # one plain step of gradient ascent, by differences, has the sign of the first Adam step
    w1, stay1 = line_crf.fit(x, ptr, y, 1)
    for k in range(3):
        e = np.eye(3)[k] * 1e-4
        slope = _log_likelihood(x, ptr, y, e, np.zeros((2, 2))) - _log_likelihood(x, ptr, y, -e, np.zeros((2, 2)))
        assert np.sign(slope) == np.sign(w1[k])
    for k in range(4):
        e = (np.eye(4)[k] * 1e-4).reshape(2, 2)
        slope = _log_likelihood(x, ptr, y, np.zeros(3), e) - _log_likelihood(x, ptr, y, np.zeros(3), -e)
        assert abs(slope) < 1e-9 or np.sign(slope) == np.sign(stay1.ravel()[k])


def test_crf_scores_are_length_weighted_means(spark):
    """A document's score from plain forward sums over every labelling of its lines."""
    rng = np.random.default_rng(5)
    model = rng.normal(size=3 * line_crf.N_OWN + 1), rng.normal(size=(2, 2))
    texts = ["one line", "A longer line of words!\n\n| x | y |\n12 34", "", "\nlast", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in line_crf.scores(df, model).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        x, ptr, size = line_crf.line_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        n, good, total = len(x), np.zeros(len(x)), 0.0
        for code in range(2**n):
            labels = [code >> i & 1 for i in range(n)]
            p = math.exp(sum(float(x[i] @ model[0]) * v for i, v in enumerate(labels)) + sum(model[1][u, v] for u, v in zip(labels, labels[1:])))
            total, good = total + p, good + p * np.array(labels)
        weight = [max(len(line), 1) for line in data.split(b"\n")]
        assert got[k] == pytest.approx(float((good / total) @ weight) / sum(weight), abs=1e-6)


def test_crf_learns_from_whole_texts(spark):
    """The bad part of a text comes after 300 good lines; it is learned all the same."""
    good = "\n".join(["This is a plain sentence of words."] * 300)
    bad = good + "\n" + "\n".join(["$$$ ### |||"] * 900)
    docs = spark.createDataFrame([(k, bad if k % 2 else good) for k in range(40)] + [(100, "$$$ ### |||"), (101, "This is a plain sentence of words.")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in line_crf.quality(docs, labels).collect()}
    assert got[100] < 0.3 < got[101]


def _plain_features(text):
    w = [x.encode() for x in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    return w, list(zip(w, w[1:])), list(zip(w, w[2:]))


def test_ftrl_equals_a_plain_loop(spark):
    """Per-coordinate FTRL-proximal with dictionaries, one feature at a time."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 12))) for _ in range(120)]
    y = [float("w3" in t.split() or "w7 w1" in t) for t in texts]
    sample = spark.createDataFrame([(t, v, k) for k, (t, v) in enumerate(zip(texts, y))], "text string, label double, ord long")
    i, w = toxicity.train(sample, epochs=3)
    # the numbers of the features, by the operator's own hash; sets and learning are plain
    sets = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        every, _ = toxicity.features(data, np.array([0, len(data)]))
        plain = sum(map(len, _plain_features(t)))
        assert len(every) == plain
        sets.append(sorted({0, *every.tolist()}))
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(3):
        for features, label in zip(sets, y):
            now = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(now.values()))))) - label
            for f in features:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA
                z[f] = z.get(f, 0.0) + g - sigma * now[f]
                n[f] = n.get(f, 0.0) + g * g
    exp = {f: weight(f) for f in z if weight(f)}
    assert dict(zip(i.tolist(), w.tolist())) == pytest.approx(exp)
    assert 3 < len(exp) < len(z) / 2
