"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are the hashes of its words, word pairs and skip-grams (a
word and the next but one), letters A-Z lower-cased, each counted once. FTRL
keeps a learning rate per coordinate and an L1 penalty, so few weights are
left; they are collected as (feature, weight) pairs and sent to all tasks.

Training: passes over a bounded sample of labelled documents (``SAMPLE`` at
most, half of each label where there are as many, chosen by a hash of the id) in one task. The bound is one
on documents: the task holds the features of their whole texts (four bytes
each) and two numbers for each of the ``DIMENSIONS`` weights.

Cases: a null or empty text has only the constant feature; null labels and
labels of unknown documents teach nothing; repeated labels of a document
count once (the larger); without labels every score is 0.5; rows that repeat
a document are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import textvec
from larder.llm.common import text_of

DIMENSIONS = 1 << 20
SAMPLE = 16_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.1
THRESHOLD = 0.3


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text it is of) of all texts; a feature may come up twice."""
    h, ptr, _ = textvec.words(data, offs, textvec.NO_LETTER, fold=True)
    own = np.repeat(np.arange(len(offs) - 1), np.diff(ptr))
    parts, owners = [h], [own]
    for gap, factor in ((1, 0xFF51AFD7ED558CCD), (2, 0xC4CEB9FE1A85EC53)):
        if len(h) > gap:
            same = own[:-gap] == own[gap:]
            parts.append(textvec.mixed(h[:-gap] * np.uint64(factor) + h[gap:])[same])
            owners.append(own[:-gap][same])
    every = (np.concatenate(parts) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1  # 0 is the constant
    return every, np.concatenate(owners)


class Ftrl:
    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _per_text(every: np.ndarray, own: np.ndarray, n: int) -> Iterator[np.ndarray]:
    order = np.argsort(own, kind="stable")
    every, cuts = every[order], np.searchsorted(own[order], np.arange(n + 1))
    for k in range(n):
        yield np.append(np.unique(every[cuts[k]:cuts[k + 1]]), 0)


def train(sample: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that are not 0, from (text, label, ord)."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for rows, data, offs in textvec.pieces(batches):
            labels = rows.column(rows.schema.get_field_index("label")).to_pylist()
            seen += [(i.astype(np.int32), y) for i, y in zip(_per_text(*features(data, offs), len(labels)), labels)]
        for _ in range(epochs):
            for i, y in seen:
                model.learn(i, y)
        i = np.flatnonzero(np.abs(model.z) > model.l1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(model.weights(i), pa.float64())], ["i", "w"])

    one = sample.repartition(1).sortWithinPartitions("ord").select("text", "label")
    found = one.mapInArrow(fit, "i long, w double").toPandas()
    return found["i"].to_numpy(), found["w"].to_numpy()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, teach, size: int) -> DataFrame:
    """(text, label, ord): at most ``size`` labelled documents for which
    ``teach`` holds, half of them of each label where there are as many,
    chosen and ordered by a hash of the id."""
    known = (labels.where(teach & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
             .select(F.col("doc_id").alias("_id"), "_y"))
    halves = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(size // 2) for y in (0, 1)]
    some = halves[0].unionByName(halves[1])
    return (docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # size rows at most
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").cast("double").alias("label"))
            .select("text", "label", F.xxhash64("doc_id").alias("ord")))


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    weights = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS, np.float32)
        w[weights.value[0]] = weights.value[1]
        for rows, data, offs in textvec.pieces(batches):
            n = rows.num_rows
            every, own = features(data, offs)
            at = np.flatnonzero(w[every])
            once = np.unique(own[at] * DIMENSIONS + every[at])
            total = np.bincount(once // DIMENSIONS, w[once % DIMENSIONS], n) + w[0]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    d = docs.select("doc_id", text_of().alias("text"))
    return d.mapInArrow(score, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def held_out_at(parts: int, part: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    held_out = held_out_at(4, 2)
    model = train(labelled_sample(docs, labels, "toxic", ~held_out, size))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
