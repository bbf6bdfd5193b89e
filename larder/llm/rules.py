"""Quality rules: base counts and distribution divergence (native).

A document's histogram of character classes and its histogram of the common
words of its language are compared with the language's reference, the same
histograms over the whole corpus, by Jensen-Shannon distance (base 2, between
0 and 1). A document is rejected if a base rule fails or if a distance is
over its limit; texts below a minimum length are not judged by distance.

References: one per language with a common-word list, and one over all
documents for any other (or null) language, whose word histogram is not
judged. They are built from the documents that pass the base rules.

Cases: a null or empty text has no words and fails the base rules; equal or
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SPACES, only, text_of, words, written

# Very common words of four languages.
COMMON_WORDS = {
    "de": ["als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht",
           "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this",
           "to", "was", "with"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su",
           "un", "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que",
           "qui", "sur", "un", "une"],
}
# Character classes, each by the characters of the class; what is in none counts as a letter of another kind.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "point": ".,;:'\"()-",
    "mark": "#*$%&|<>!?@/\\_+=[]{}~^`",
}
MIN_CHARS, MIN_WORDS = 400, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.30
N_WORDS_LEAST, REPEAT_PERCENT, WINDOW = 10, 20, 5


def repeated_words(wh: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or
    more in the text. ``wh``: the words' hashes. Windows are compared by a
    64-bit hash of their words' hashes."""
    def chain(a: Column) -> Column:
        # doubling: 2 words, 4 words, then one more
        two = F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
        four = F.zip_with(two, F.slice(two, 3, F.greatest(F.size(a) - 3, F.lit(0))), lambda x, y: F.xxhash64(x, y))
        return F.zip_with(F.slice(four, 1, F.size(a) - 4), F.slice(a, 5, F.size(a) - 4), lambda x, y: F.xxhash64(x, y))
    assert window == 5
    return F.when(F.size(wh) >= window, chain(wh)).otherwise(F.array().cast("array<bigint>"))


def by_hash(win: Column) -> Column:
    """The windows (hash, position) in order of their hashes."""
    return F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_starts(placed: Column) -> Column:
    """Positions, ascending, of the windows that occur twice or more: a
    neighbour in hash order has the same hash. ``placed`` must be a column
    that holds ``by_hash``, as the lambda reads it for every element."""
    n = F.size(placed)
    twice = F.filter(placed, lambda x, k: ((k > 0) & (F.get(placed, k - 1)["h"] == x["h"]))
                     | ((k < n - 1) & (F.get(placed, k + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def union_length(starts: Column, window: int = WINDOW) -> Column:
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                      F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
                      lambda later, first: F.least(later - first, F.lit(window)))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(window), lambda a, x: a + x)).otherwise(0)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, arrays of counts."""
    def shares(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return F.transform(a, lambda x: x / total)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (as they are) and the measures of each text."""
    d = docs.select(*keep, F.col("lang").alias("_lang"), text_of().alias("_text"))
    d = d.select(*keep, "_lang", "_text", F.length("_text").alias("_n_chars"), words(F.col("_text")).alias("_words"),
                 F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    d = d.select(*keep, "_lang", "_text", "_n_chars", "_lines", F.size("_words").cast("long").alias("n_words"),
                 F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
                 F.transform("_words", lambda w: F.xxhash64(w)).alias("_wh"))
    known = F.col("_lang").isin(*COMMON_WORDS)
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items()
                           for x in (F.lit(k), F.array(*[F.xxhash64(F.lit(w)) for w in v]))])
    d = (d.withColumn("_lang", F.when(known, F.col("_lang")).otherwise("*"))
         .withColumn("_list", F.coalesce(F.element_at(lists, F.col("_lang")), F.array().cast("array<bigint>"))))
    d = d.withColumn("_win", repeated_words(F.col("_wh")))
    # most texts repeat no window: only the others sort theirs
    d = d.withColumn("_placed", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), by_hash(F.col("_win"))))
    d = d.withColumn("_starts", F.coalesce(repeated_starts(F.col("_placed")), F.array().cast("array<int>")))
    chars = F.array(*[(F.col("_n_chars") - _without(F.col("_text"), c)).cast("double") for c in CLASSES.values()])
    # only the listed words stay; how often each occurs is what removing it takes away
    d = d.withColumn("_listed", F.filter("_wh", lambda h: F.array_contains(F.col("_list"), h)))
    common = F.transform("_list", lambda w: (F.size("_listed") - F.size(F.array_remove("_listed", w))).cast("double"))

    def with_rest(a: Column, total: str) -> Column:
        return F.concat(a, F.array(F.col(total).cast("double") - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))
    d = d.select(
        *keep, "_lang", "n_words", "word_chars", "_n_chars",
        (F.col("_n_chars") - _without(F.col("_text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        union_length(F.col("_starts")).cast("long").alias("n_repeat_words"), chars.alias("_chars"), common.alias("_common"))
    d = (d.withColumn("_chars", with_rest(F.col("_chars"), "_n_chars"))
         .withColumn("_common", with_rest(F.col("_common"), "n_words")))
    return d.withColumn("base_failed", (F.col("n_words") < N_WORDS_LEAST)
                        | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))


def references(m: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Summed histograms (characters, words) by language, and over all under
    ``*``, of the measured documents that pass the base rules: five rows at
    most reach the driver."""
    def summed(col: str, n: int) -> list[Column]:
        return [F.coalesce(F.sum(F.get(F.col(col), F.lit(k))), F.lit(0.0)) for k in range(n)]
    nc, nw = len(CLASSES) + 1, len(COMMON_WORDS["en"]) + 1
    sums = (only(m, ~F.col("base_failed")).groupBy("_lang")
            .agg(F.array(*summed("_chars", nc)).alias("c"), F.array(*summed("_common", nw)).alias("w")).collect())
    found = {r["_lang"]: (list(r["c"]), list(r["w"])) for r in sums}
    every = ([sum(c[k] for c, _ in found.values()) for k in range(nc)], [sum(w[k] for _, w in found.values()) for k in range(nw)])
    return found | {"*": every}


def judge(m: DataFrame, refs: dict[str, tuple[list[float], list[float]]], max_class: float = MAX_CLASS_DISTANCE,
          max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds class_distance, word_distance (null where a text is too short or
    has no reference) and kept to measured documents."""
    def ref(k: int) -> Column:
        out = F.array(*[F.lit(float(x)) for x in refs["*"][k]])
        for lang in sorted(refs.keys() - {"*"}):
            out = F.when(F.col("_lang") == lang, F.array(*[F.lit(float(x)) for x in refs[lang][k]])).otherwise(out)
        return out

    known = F.lit(sum(refs["*"][0]) > 0)
    return (m.withColumn("_cref", ref(0)).withColumn("_wref", ref(1))
            .withColumn("class_distance", F.when(known & (F.col("_n_chars") >= min_chars), distance(F.col("_chars"), F.col("_cref"))))
            .withColumn("word_distance", F.when(known & (F.col("n_words") >= min_words) & F.col("_lang").isin(*(refs.keys() - {"*"})),
                                                distance(F.col("_common"), F.col("_wref"))))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= max_class)
                        & (F.coalesce("word_distance", F.lit(0.0)) <= max_word))
            .drop("_cref", "_wref"))


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, both distances, kept."""
    m = written(measured(docs, ["doc_id"]), "rules-measured")
    return judge(m, references(m), **limits).drop("_lang", "_n_chars", "_chars", "_common")


def accepted_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Texts are measured twice, so
    that none has to be shuffled."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang")
    refs = references(measured(docs, ["doc_id"]))
    return only(judge(measured(row, ["_row"]), refs, **limits), F.col("kept")).select("_row.*")
