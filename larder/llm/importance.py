"""Importance resampling towards a target distribution, over hashed n-grams.

Features of a text are all runs of one to three consecutive words (letters
A-Z lower-cased; words are what lies between ASCII characters that are no
letter or digit), repeats counted; a feature's bucket is its crc32 modulo
``BUCKETS``. Bucket counts of the documents (source) and of the target texts
give each bucket a gain, the scaled log ratio of its smoothed shares; a
document's weight is the sum of the gains of its features, and Gumbel noise
from a hash of its id turns the largest scores into a draw without replacement.

Both passes intern the n-grams of a batch in open-addressed tables
(``interning``), so an n-gram's bytes are hashed and its crc32 is taken once a
batch; the first pass adds up the slots' counts by bucket, the second gathers
the gains of the slots by occurrence. The bucket counts, ``BUCKETS`` numbers
whatever the corpus, are all that reaches the driver or is broadcast.

The draw ranks (score, doc_id) rows by a range sort with offsets, so neither
the driver nor one task sees them all; ties of rows with one id go by the
order in which they were written.

Cases: a null or empty text has no feature, weight 0 and is never drawn; a
null ``doc_id`` hashes as if it were empty and comes first among ties;
repeated rows count as often and are drawn each for itself; an empty table
gives an empty result, no target texts give gains from the smoothing alone.
Texts of any length are taken whole, some ``interning.SEGMENT`` words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import interning, textvec
from larder.llm.common import running_sum, text_of, written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for _, data, offs in textvec.pieces(batches):
        for _, _, crc, count in interning.ngrams(textvec.LOWER[data], offs, textvec.NO_LETTER):
            held = np.flatnonzero(count)
            np.add.at(total, crc[held] % np.uint32(BUCKETS), count[held])
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    each = texts.select(text_of().alias("text")).mapInArrow(_counted, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of its share in the target
    over its share in the source, both smoothed by one feature a bucket."""
    top = (target + 1).astype(float) * float(source.sum() + BUCKETS)
    return np.floor(1000 * np.log(top / ((source + 1).astype(float) * float(target.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textvec.pieces(batches):
            n = rows.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for k, (own, slot, crc, _) in enumerate(interning.ngrams(textvec.LOWER[data], offs, textvec.NO_LETTER)):
                worth = shared.value[crc % np.uint32(BUCKETS)][slot]
                here, first = np.unique(own, return_index=True)
                if len(here):
                    weight[here] += np.add.reduceat(worth, first)
                found = np.bincount(own, minlength=n)
                n_features += found
                if k % 3 == 0:
                    n_words += found
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, (n_words, n_features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score and rank (from 1, of
    the drawn rows: ``percent`` of those with ``least`` words; others null)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weights(docs, gain).withColumn("score", F.col("weight") + noise), "importance-scores")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    ranked = running_sum(able.withColumn("_one", F.lit(1).cast("long")).withColumn("_row", F.monotonically_increasing_id()),
                         [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row")], "_one", "_rank", "_at", "importance-ranked")
    ranked = ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


ORACLE_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (
  SELECT doc_id AS id, false AS target, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, true, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
word AS (SELECT id, target, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT id, target, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f
  FROM word, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
counted AS (SELECT id, target, f, count(*) AS c FROM feature GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c >> 8, tab.t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM counted), tab),
bucket AS (
  SELECT b, sum(c) FILTER (WHERE NOT target) AS s, sum(c) FILTER (WHERE target) AS t FROM counted JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM bucket),
gain AS (
  SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(tt, 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM bucket, totals),
weighed AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (b) WHERE NOT target GROUP BY id),
scored AS (
  SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM word d LEFT JOIN weighed USING (id) WHERE NOT d.target),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
