"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex with an edge: the smallest id it reaches.

    ``edges`` has ``a`` and ``b``. By contraction: every vertex moves to its
    smallest neighbour (or stays), edges follow, loops and repeats go, until
    no edge is left. A smallest vertex never moves, so it is what remains of
    its component. Each round is written, so no lineage grows.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "graph-edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("_v"), F.least("a", "b").alias("_to")), "graph-moves")
        if labels is None:
            labels = moves.select(F.col("_v").alias("id"), F.col("_to").alias("label"))
        else:
            labels = written(labels.join(moves, F.col("label") == F.col("_v"), "left")
                             .select("id", F.coalesce("_to", "label").alias("label")), "graph-labels")
        other = moves.select(F.col("_v").alias("_w"), F.col("_to").alias("_wto"))
        edges = written(edges.join(moves, F.col("a") == F.col("_v")).join(other, F.col("b") == F.col("_w"))
                        .select(F.col("_to").alias("a"), F.col("_wto").alias("b")).where("a <> b").distinct(), "graph-edges")
        if edges.limit(1).count() == 0:
            return labels
