"""Mixing sources to target weights by weighted fair queueing (native).

Every source's documents are shuffled by a hash of their id. A copy of a
document gets a virtual finish time: the source's words up to and including
it, divided by the source's target. All copies are range-sorted by that time
and the order is cut where the words reach the total budget, so every source
is served in proportion to its target at any prefix of the mix.

Cases: a null text or one without words has size 0 and takes 0 words; a null
source is a source of its own, last in order; rows that repeat a document are
documents of their own and each row has its own copies; an empty table gives an empty mix; equal finish times
are ordered by source, hash, id and size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import running_sum, text_of, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, words_before, target)``, one row per source.

    ``sizes`` has ``source`` and ``size``. The budget (``share`` of all words)
    is shared by weight; a target stops at ``max_copies`` times its source and
    the excess is reshared by weight until none is above. That is a water
    level: sources in ascending order of cap per weight are capped while the
    level over the rest still reaches their cap.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    prior = by_source.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("words_before", F.coalesce(F.sum("source_size").over(prior), F.lit(0)))
         .withColumn("_w", weight)
         .withColumn("_cap", F.col("source_size") * max_copies)
         .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share))))
    rising = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    s = (s.withColumn("_caps", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_rest", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_full", F.col("_cap") <= F.col("_w") * ((F.col("_budget") - F.col("_caps")) / F.col("_rest"))))
    level = ((F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every))
             / F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    return s.select("source", "source_size", "words_before", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
        seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies (how often the mix takes the document) and taken (its words)."""
    sizes = written(docs.select("doc_id", "source", F.size(words(text_of())).cast("long").alias("size")), "mix-sizes")
    return _judged(sizes, [], weights, share, max_copies, seed)


def _judged(sizes: DataFrame, carried: Sequence[str], weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """``mix`` of (doc_id, source, size); columns ``carried`` order rows that
    are equal in those and are returned too."""
    targets = written(source_targets(sizes, weights, share, max_copies), "mix-targets")
    shuffled = sizes.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    served = running_sum(shuffled, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("size"),
                                    *carried],
                         "size", "_upto", "_row", "mix-served")
    t = targets.withColumnRenamed("source", "_source")
    queued = (served.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
              .withColumn("_finish", F.when(F.col("target") > 0, (F.col("_copy") * F.col("source_size") + F.col("_upto")
                                                                 - F.col("words_before")) / F.col("target"))))
    order = [F.col("_finish").asc_nulls_last(), F.col("_row"), F.col("_copy")]
    budget = targets.agg(F.floor(F.sum("target")).alias("_total"))
    cut = (running_sum(queued, order, "size", "_sent", "_at", "mix-queue").join(F.broadcast(budget))  # one row
           .withColumn("_in", (F.col("_sent") <= F.col("_total")).cast("long")))
    return (cut.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target", *carried)],
                                    F.sum("_in").alias("copies"), F.sum(F.col("_in") * F.col("size")).alias("taken"))
            .drop("_row"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.
    Rows are written with an id of their own, so that rows which share a
    doc_id, or have none, get the copies that the mix gave to each."""
    rows = written(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_id")), "mix-rows")
    text = text_of("_doc.text")
    sizes = written(rows.select("_doc.doc_id", "_doc.source", F.size(words(text)).cast("long").alias("size"),
                                F.xxhash64(text).alias("_hash"), "_id"), "mix-sizes")
    times = _judged(sizes, ["_hash", "_id"], **options).where("copies > 0").select(F.col("_id").alias("_at"), F.col("copies").cast("int"))
    return (rows.join(times, F.col("_id") == F.col("_at"))
            .withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*"))


# The hash of an id, the running sums and the water level as DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s0),
s2 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps,
         (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest FROM s1),
s3 AS (SELECT *, cap <= w * ((budget - caps) / rest) AS is_full FROM s2),
s4 AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
         w * ((budget - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE)
              / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE) END AS target FROM s3),
o AS (
  SELECT d.*, row_number() OVER (ORDER BY source NULLS LAST, md5('0:' || doc_id), doc_id, size) AS rid,
         sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d),
q AS (
  SELECT o.*, s4.source_size, s4.target, c.copy,
         CASE WHEN s4.target > 0 THEN (c.copy * s4.source_size + o.upto)::DOUBLE / s4.target END AS finish
  FROM o JOIN s4 ON o.source IS NOT DISTINCT FROM s4.source, (VALUES (0), (1)) AS c(copy)),
sent AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, rid, copy ROWS UNBOUNDED PRECEDING) AS upto_all FROM q)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN upto_all <= (SELECT floor(sum(target)) FROM s4) THEN size ELSE 0 END)::BIGINT AS taken
FROM sent GROUP BY rid, doc_id, size, source_size, target
"""
