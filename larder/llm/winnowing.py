"""Document fingerprints by winnowing (native).

Hashes of all k-grams of words slide through windows of ``w`` consecutive
k-grams; each window marks its smallest hash, the rightmost one if there are
ties, and a mark is kept once with its position. Any run of ``w + k - 1`` or
more words that two texts share therefore leaves a mark that both have.

A mark is one long: 31 bits of hash, then the position counted down, so that
the least value of a window is the smallest hash at its rightmost place.

Cases: a null or empty text has no marks; a text of fewer than ``k`` words has
one mark, of all its words; fewer than ``w`` k-grams are one window; two texts
without marks are alike (1.0); rows that repeat id and text count as one
document, and each gets its result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import running_sum, text_of, words, written

K, W = 4, 8
_LOW = 0x7FFFFFFF


def _paired(a: str, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the one ``by`` places on."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), f)


def _steps(n: int) -> list[int]:
    """Shifts that widen a span of 1 to ``n`` by doubling."""
    out, have = [], 1
    while have < n:
        out.append(min(have, n - have))
        have += out[-1]
    return out


def with_marks(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``: array<bigint>, the text's marks by position."""
    kept = df.columns
    # each step is a column of its own: it is read more than once by the next
    df = df.withColumn("_words", words(F.col(text)))
    df = df.select(*kept, F.transform("_words", lambda x: F.xxhash64(x)).alias("_wh"))
    df = df.withColumn("_g", F.col("_wh"))
    span = 1
    for by in _steps(k):
        # doubling while it fits, then the last word of an odd rest
        df = df.withColumn("_g", _paired("_g", by, lambda x, y: F.xxhash64(x, y)))
        span += by
    whole = F.when(F.size("_wh") > 0, F.array(F.xxhash64("_wh"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", F.when(F.size("_wh") >= k, F.col("_g")).otherwise(whole))
    packed = F.transform("_g", lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(_LOW).cast("long")), 32)
                         .bitwiseOR(F.lit(_LOW).cast("long") - i))
    df = df.select(*kept, packed.alias("_p")).withColumn("_m", F.col("_p"))
    for by in _steps(w):
        df = df.withColumn("_m", _paired("_m", by, lambda x, y: F.least(x, y)))
    marks = (F.when(F.size("_p") >= w, F.array_distinct("_m"))
             .when(F.size("_p") > 0, F.array(F.array_min("_p"))).otherwise(F.array().cast("array<bigint>")))
    return df.select(*kept, marks.alias(out))


def positions_and_hashes(marks: Column) -> Column:
    """``position:hash`` of every mark, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(
        ":", (F.lit(_LOW) - m.bitwiseAND(F.lit(_LOW).cast("long"))).cast("string"), F.shiftright(m, 32).cast("string"))), ",")


def hashes(marks: Column) -> Column:
    """The distinct hashes of the marks, without positions."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32).cast("int")))


def likeness(x: Column, y: Column) -> Column:
    """Shared share of two sets of hashes (Jaccard)."""
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, _n, next_id, next_h): each document's next by ascending id
    and the first after the last. ``_h`` is a hash of the text, ``_n`` its length."""
    ids = written(docs.select("doc_id", F.xxhash64(text_of()).alias("_h"), F.length(text_of()).alias("_n"))
                  .groupBy("doc_id", "_h", "_n").agg(F.lit(1).alias("_one")), "winnow-ids")
    ranked = running_sum(ids, [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_n")], "_one", "_rank", "_at", "winnow-ranked")
    last = ranked.agg(F.max("_rank").alias("_last"))
    nexts = (ranked.join(F.broadcast(last))  # one row
             .select(F.when(F.col("_rank") == 1, F.col("_last")).otherwise(F.col("_rank") - 1).alias("_rank"),
                     F.col("doc_id").alias("next_id"), F.col("_h").alias("next_h")))
    return written(ranked.join(nexts, "_rank").select("doc_id", "_h", "_n", "next_id", "next_h"), "winnow-next")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has its last
    floor(n_chars / 2) code points replaced by as many first ones of the next
    document (or all it has)."""
    follow = successors(docs)
    # both joins below take the texts by the same key, so they move once for the two of them
    texts = docs.select("doc_id", text_of().alias("_text")).withColumn("_h", F.xxhash64("_text"))
    to = follow.select(F.col("doc_id").alias("to_id"), F.col("_h").alias("to_h"), "_n", "next_id", "next_h")
    # to each document its successor's beginning and the hashes of its marks; a repeated row stands for the document once
    given = (texts.join(to.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("_h") == F.col("next_h")))
             .select("to_id", "to_h", "_text", F.expr("substring(_text, 1, _n div 2)").alias("_piece")))
    given = with_marks(given, "_text", "_next", k, w).select("to_id", "to_h", "_piece", hashes(F.col("_next")).alias("_next_hashes"))
    if docs.select("doc_id", F.xxhash64(text_of()).alias("_h")).groupBy("doc_id", "_h").count().where("count > 1").limit(1).count():
        given = given.dropDuplicates(["to_id", "to_h"])
    both = (texts.join(given, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("_h") == F.col("to_h")))
            .select("doc_id", "_text", "_next_hashes", F.length("_text").alias("_chars"),
                    F.expr("concat(substring(_text, 1, length(_text) - length(_text) div 2), _piece)").alias("_edited")))
    both = with_marks(both, "_text", "_marks", k, w).drop("_text")
    both = with_marks(both, "_edited", "_edited_marks", k, w)
    return both.select("doc_id", F.col("_chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
                       positions_and_hashes(F.col("_marks")).alias("fingerprint"),
                       positions_and_hashes(F.col("_edited_marks")).alias("edited_fingerprint"),
                       likeness(hashes(F.col("_marks")), hashes(F.col("_edited_marks"))).alias("near_edited"),
                       likeness(hashes(F.col("_marks")), F.col("_next_hashes")).alias("near_next"))
