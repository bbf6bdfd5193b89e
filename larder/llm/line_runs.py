"""Line dedup over the suffix array of line ids, by prefix doubling (native).

Documents are sequences of line ids (a hash of 128 bits; lines without a word
have no id and stay). In the order of line ids that puts lines which occur
once first, by position, and then the others by hash, suffixes are sorted by
prefix doubling: suffixes of equal rank over ``h`` lines are an interval of
the suffix array with a common prefix of ``h`` lines or more; their rank over
``2 h`` lines follows from the pair (rank here, rank ``h`` lines on). A suffix
alone in its interval is in its final place and leaves the sort, so each round
moves only what is repeated, and the rounds end at the longest repeated run.

In each interval the earliest suffix (by document id, then position) is the
original, the others start later copies. A repeated run is deleted from where
it is a later copy if it has two lines or more, or is one line of at least
``min_words`` words. (A run of two lines or more is the union of its pairs.)

Cases: a null text is the empty text; rows that repeat id and text are one
document and get equal results; documents that share an id are ordered by a
hash of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import running_sum, text_of, words, written

MIN_WORDS = 5


def line_ids(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: doc_id, _h (hash of the text), seq (among
    such lines), pos (among all), a and b (the id), solid (enough words to be
    deleted alone)."""
    lines = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    d = docs.select("doc_id", text_of().alias("_text"))
    return (d.select("doc_id", F.xxhash64("_text").alias("_h"),
                     F.posexplode(F.filter(lines, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))).alias("seq", "_l"))
            .select("doc_id", "_h", "seq", "_l.pos", F.xxhash64("_l.line").alias("a"),
                    F.xxhash64(F.lit("2"), F.col("_l.line")).alias("b"),
                    (F.size(words(F.col("_l.line"))) >= min_words).alias("solid")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(deleted, copied): lines to delete (doc_id, _h, pos), and per document
    the longest run found to be a later copy, as the last doubling that it
    survived (doc_id, _h, copied_run)."""
    place = F.struct(F.col("doc_id"), F.col("_h"), F.col("seq"))
    lines = written(line_ids(docs, min_words), "lines")
    groups = (lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1"))
    ranked = running_sum(groups.select("a", "b", "_n", "_first"), [F.col("a"), F.col("b")], "_n", "rank", "_at", "line-ranks")
    # repeated rows of one document share their places
    active = written(lines.join(ranked.select("a", "b", "rank", "_first"), ["a", "b"])
                     .select("doc_id", "_h", "seq", "pos", "solid", "rank", (place > F.col("_first")).alias("later"))
                     .dropDuplicates(["doc_id", "_h", "seq"]), "line-suffixes")
    deleted = [active.where("later AND solid").select("doc_id", "_h", "pos")]
    copied = [active.where("later").select("doc_id", "_h", F.lit(1).alias("copied_run")).distinct()]
    h = 1
    while True:
        ahead = active.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_dh"), (F.col("seq") - h).alias("_s"),
                              F.col("rank").alias("rank2"), F.col("pos").alias("pos2"))
        # a suffix whose continuation occurs once is alone in its interval
        pairs = (active.join(ahead, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_dh")) & (F.col("seq") == F.col("_s")))
                 .select("doc_id", "_h", "seq", "pos", "pos2", "rank", "rank2"))
        groups = (pairs.groupBy("rank", "rank2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1"))
        ranked = running_sum(groups, [F.col("rank"), F.col("rank2")], "_n", "_new", "_at", "line-ranks")
        nxt = written(pairs.join(ranked, ["rank", "rank2"])
                      .select("doc_id", "_h", "seq", "pos", "pos2", F.col("_new").alias("rank"), (place > F.col("_first")).alias("later")),
                      "line-suffixes")
        h *= 2
        later = nxt.where("later")
        if h == 2:
            deleted.append(later.select("doc_id", "_h", F.explode(F.array("pos", "pos2")).alias("pos")))
        if nxt.limit(1).count() == 0:
            break
        copied.append(later.select("doc_id", "_h", F.lit(h).alias("copied_run")).distinct())
        active = nxt.drop("pos2", "later")
    gone, runs = deleted[0], copied[0]
    for x in deleted[1:]:
        gone = gone.unionByName(x)
    for x in copied[1:]:
        runs = runs.unionByName(x)
    return gone, runs.groupBy("doc_id", "_h").agg(F.max("copied_run").alias("copied_run"))


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` as ``_row`` with _kept (the text without later
    copies; null stays null), _n_lines, _n_removed and _copied_run."""
    gone, runs = repeated_runs(docs, min_words)
    per_doc = (gone.groupBy("doc_id", "_h").agg(F.collect_set("pos").alias("_gone"))
               .select(F.col("doc_id").alias("_d"), F.col("_h").alias("_dh"), "_gone"))
    per_doc = written(per_doc.join(runs.select(F.col("doc_id").alias("_rd"), F.col("_h").alias("_rh"), "copied_run"),
                                   F.col("_d").eqNullSafe(F.col("_rd")) & (F.col("_dh") == F.col("_rh"))).drop("_rd", "_rh"), "lines-gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    here = F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(text_of("_row.text")) == F.col("_dh"))
    out = rows.join(per_doc.hint("shuffle_hash"), here, "left").select(
        "_row", "_gone", "copied_run", F.split(text_of("_row.text"), "\n", -1).alias("_lines"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    return out.select("_row", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(stay, "\n")).alias("_kept"),
                      F.when(F.col("_row.text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("_n_lines"),
                      F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_removed"),
                      F.coalesce("copied_run", F.lit(0)).cast("long").alias("_copied_run"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and kept (the text that is left)."""
    return without_later_copies(docs, min_words).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.coalesce("_kept", F.lit("")).alias("kept"))


def deduplicated_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with later copies taken out of their texts. A
    document of which no word is left was a later copy as a whole and goes;
    n_chars, where there is such a column, is counted anew."""
    out = without_later_copies(docs, min_words).where(
        (F.col("_n_removed") == 0) | F.coalesce("_kept", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    cols = []
    for f in docs.schema.fields:
        if f.name == "text":
            cols.append(F.col("_kept").alias("text"))
        elif f.name == "n_chars":
            cols.append(F.length("_kept").cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col("_row")[f.name].alias(f.name))
    return out.select(*cols)


# Pairs of lines stand for all longer runs.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq,
         lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS pos2,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 5 AS solid
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS later1,
         line2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, seq) > 1 AS later2 FROM w),
gone AS (
  SELECT doc_id, pos FROM r WHERE later1 AND solid UNION SELECT doc_id, pos FROM r WHERE later2
  UNION SELECT doc_id, pos2 FROM r WHERE later2)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
