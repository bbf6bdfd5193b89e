"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are its share
of character classes, its length and its words, and the same of the lines
before and after it; a transition weight ties neighbouring labels.
Forward-backward gives each line's probability of being good, and their mean,
weighted by the lines' lengths, is the document's quality.

Training: document labels hold for all lines of the document. The whole texts
of a bounded sample (``SAMPLE`` labelled documents at most, by a hash of the
id) are fitted by gradient ascent on the conditional likelihood, some
``BLOCK`` lines at a time. The bound is one on documents: the task that fits
holds 46 numbers for each of their lines.

Cases: a null or empty text is one empty line; null labels and labels of
unknown documents teach nothing, repeated labels of a document count once
(the larger); without labels every score is 0.5; rows that repeat a document
are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import textvec
from larder.llm.common import text_of
from larder.llm.toxicity import held_out_at, labelled_sample

SAMPLE = 4_000
#: Lines whose chains are worked on at a time in training.
BLOCK = 1 << 16
STEPS, RATE, PENALTY = 300, 0.1, 1e-4
THRESHOLD = 0.3

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b".,;:", b"!?", b"|", b"#*$%&<>",
          b"'\"()-/@_=+[]{}~^`\\", bytes(range(128, 256))]
N_OWN = len(_KINDS) + 5


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours, first line of each text and
    the number of all, length in bytes of each line)."""
    n = len(offs) - 1
    feed = np.flatnonzero(data == 10)
    # a line ends at a line feed or with its text
    ends = np.concatenate([feed, offs[1:]])
    # a text ends before a line feed at the same byte, which is the first of a later text
    order = np.lexsort((np.concatenate([np.ones(len(feed)), np.zeros(n)]), ends))
    ends, is_text = ends[order], (order >= len(feed))
    text_of_line = np.concatenate([[0], np.cumsum(is_text)[:-1]]).astype(np.int64)
    starts = np.where(np.concatenate([[True], is_text[:-1]]), offs[text_of_line], np.concatenate([[0], ends[:-1] + 1]))
    size = (ends - starts).astype(np.float64)
    x = np.zeros((len(ends), N_OWN), np.float32)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]
    for k, chars in enumerate(_KINDS):
        member = np.zeros(256, bool)
        member[list(chars)] = True
        x[:, k] = count(member[data]) / np.maximum(size, 1)
    first = ~textvec.SPACE[data]
    first[1:] &= textvec.SPACE[data[:-1]]
    n_words = count(first)
    k = len(_KINDS)
    x[:, k] = np.log1p(size) / 8
    x[:, k + 1] = np.log1p(n_words) / 6
    x[:, k + 2] = np.minimum(size / np.maximum(n_words, 1), 20) / 20
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    x[:, k + 3] = (size > 0) & np.isin(last, np.frombuffer(b".!?", np.uint8))
    x[:, k + 4] = size == 0
    # neighbours of the same text
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = text_of_line[1:] == text_of_line[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    ptr = np.searchsorted(text_of_line, np.arange(n + 1))
    return np.hstack([x, before, after, np.ones((len(x), 1), np.float32)]), ptr, size


def marginals(unary: np.ndarray, ptr: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward, all texts at once.

    ``unary``: the score of good over bad; ``stay``: 2 x 2 transition scores.
    Texts are in order of length, so step t touches those with t lines only.
    """
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    begin, size = ptr[:-1][order], size[order]
    steps = int(size.max()) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # texts with at least t lines
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    score = np.stack([np.zeros(len(unary)), unary], 1)
    for t in range(steps):
        i = begin[:alive[t]] + t
        forward[i] = score[i]
        if t:
            before = forward[i - 1][:, :, None] + stay[None]
            forward[i] += np.logaddexp(before[:, 0], before[:, 1])
    for t in range(1, steps):
        # t lines from the end
        i = begin[:alive[t]] + size[:alive[t]] - 1 - t
        after = stay[None] + (score[i + 1] + backward[i + 1])[:, None, :]
        backward[i] = np.logaddexp(after[:, :, 0], after[:, :, 1])
    total = forward + backward
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -30, 30)))


def _pair_expectations(unary: np.ndarray, ptr: np.ndarray, stay: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and the expected transitions, summed with the lines' weights."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    begin, size = ptr[:-1][order], size[order]
    steps = int(size.max())
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    score = np.stack([np.zeros(len(unary)), unary], 1)
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for t in range(steps):
        i = begin[:alive[t]] + t
        forward[i] = score[i]
        if t:
            before = forward[i - 1][:, :, None] + stay[None]
            forward[i] += np.logaddexp(before[:, 0], before[:, 1])
    expected = np.zeros((2, 2))
    for t in range(1, steps):
        i = begin[:alive[t]] + size[:alive[t]] - 1 - t
        after = stay[None] + (score[i + 1] + backward[i + 1])[:, None, :]
        backward[i] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        pair = forward[i][:, :, None] + after
        pair -= pair.max((1, 2), keepdims=True)
        pair = np.exp(pair)
        expected += (pair / pair.sum((1, 2), keepdims=True) * weight[i][:, None, None]).sum(0)
    total = forward + backward
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -30, 30))), expected


def fit(x: np.ndarray, ptr: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(line weights, transitions) that maximise the conditional likelihood
    of texts whose lines all have the text's label. Every text counts alike,
    whatever its lines, and both labels count alike in sum."""
    size = np.diff(ptr)
    label = np.repeat(y, size)
    share = np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1)) / 2
    weight = np.repeat(share / size, size)
    kept = np.zeros((2, 2))
    for k in (0, 1):
        kept[k, k] = (share * (size - 1) / size)[y == k].sum()
    # whole texts in blocks: their gradients add up
    cuts = [0]
    for k in range(1, len(ptr)):
        if k == len(ptr) - 1 or ptr[k + 1] - ptr[cuts[-1]] > BLOCK:
            cuts.append(k)
    w, stay = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(stay)]
    v = [np.zeros_like(w), np.zeros_like(stay)]
    for step in range(1, steps + 1):
        grads = [-PENALTY * w, kept - PENALTY * stay]
        for a, b in zip(cuts, cuts[1:]):
            i = slice(ptr[a], ptr[b])
            own = x[i].astype(np.float64)
            p, expected = _pair_expectations(own @ w, ptr[a:b + 1] - ptr[a], stay, weight[i])
            grads[0] += own.T @ ((label[i] - p) * weight[i])
            grads[1] -= expected
        for k, (value, g) in enumerate(zip((w, stay), grads)):  # Adam
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, stay


def train(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted in one task that gets the bounded sample."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, sizes, ys = [], [], []
        for rows, data, offs in textvec.pieces(batches):
            x, ptr, _ = line_features(data, offs)
            for k, y in enumerate(rows.column(rows.schema.get_field_index("label")).to_pylist()):
                xs.append(x[ptr[k]:ptr[k + 1]])
                sizes.append(len(xs[-1]))
                ys.append(y)
        if ys:
            w, stay = fit(np.concatenate(xs), np.concatenate([[0], np.cumsum(sizes)]), np.array(ys))
            yield pa.RecordBatch.from_arrays([pa.array([[*w, *stay.ravel()]], pa.list_(pa.float64()))], ["model"])

    found = sample.repartition(1).sortWithinPartitions("ord").select("text", "label").mapInArrow(learn, "model array<double>").collect()
    if not found:
        return np.zeros(3 * N_OWN + 1), np.zeros((2, 2))
    model = np.array(found[0]["model"])
    return model[:-4], model[-4:].reshape(2, 2)


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    w, stay = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textvec.pieces(batches):
            x, ptr, size = line_features(data, offs)
            p = marginals(x @ w, ptr, stay)
            weight = np.maximum(size, 1)
            own = np.repeat(np.arange(rows.num_rows), np.diff(ptr))
            mean = np.bincount(own, p * weight, rows.num_rows) / np.bincount(own, weight, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.clip(mean, 0, 1), pa.float64())], ["doc_id", "score"])

    d = docs.select("doc_id", text_of().alias("text"))
    return d.mapInArrow(score, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    held_out = held_out_at(5, 0)
    model = train(labelled_sample(docs, labels, "quality", ~held_out, size))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
