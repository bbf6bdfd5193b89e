"""Language identification by language-bitmask n-gram filters.

Letters are lower-cased; an n-gram is a run of two to ``LONGEST`` bytes of a
word with a space before and after it. Training counts the n-grams of every
training text by language (numbers are summed in each task before they
travel) and takes the ``KEPT`` most frequent of each language.

Those go into a bit-sliced Bloom filter: ``SLICES`` arrays of ``CELLS`` masks
with one bit for each language. An n-gram sets its language's bit in one cell
of each array; the masks of its cells, ANDed, are all languages that contain
it, found by the same few reads however many languages there are. A text's
popcounts by language over all its n-grams are corrected for the false
positives to be expected from how full the language's bits are; the largest
corrected share decides (ties: the first value by code point).

What is broadcast has a bound: 8 bytes x ``SLICES`` x ``CELLS`` for every 64
languages, and there may be ``LANGUAGES`` at most (more are an error, none is
dropped).

Cases: a null text and one without a letter are ``und`` with score 0; so is
every text if nothing was learned; a text of which no n-gram is known gets the
first language and score 0; rows without a language or a text teach nothing;
a null ``doc_id`` is not held out; repeated rows count as often; an empty
table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import textvec
from larder.llm.common import text_of

LONGEST = 4
KEPT = 2048
SLICES = 3
CELLS = 1 << 15
LANGUAGES = 4096
#: Different (language, n-gram) pairs that a task holds before it passes them on.
HELD = 4_000_000
#: Bytes of text that a task turns into n-grams at a time.
PIECE = 1 << 20
#: Tasks that rank the n-grams of one language.
SHARES = 16
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def ngrams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, text it is of) of every occurrence, one length at a time. The
    bytes of an n-gram are packed into its number, so none collide."""
    at = np.flatnonzero(LETTER[data])
    if not len(at):
        return
    own = np.searchsorted(offs, at, "right") - 1
    new = np.append(True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))
    word = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # each word with a space before it, and one at the end
    stream = np.full(len(at) + len(first) + 1, 32, np.uint64)
    stream[np.arange(len(at)) + word + 1] = data[at]
    size = np.diff(np.append(first, len(at))) + 1
    end = np.repeat(np.cumsum(size), size)  # of each place: the space behind its word
    text = np.repeat(own[first], size)
    place = np.arange(len(stream) - 1)
    packed = stream
    for n in range(2, LONGEST + 1):
        packed = packed[:-1] | (stream[n - 1:] << np.uint64(8 * (n - 1)))
        whole = place[:len(packed)] + n - 1 <= end[:len(packed)]
        yield packed[whole], text[:len(packed)][whole]


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    k = batch.schema.get_field_index("text")
    return batch.set_column(k, "text", pc.utf8_lower(batch.column(k)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[str, int] = {}
    names: list[str] = []
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        lang = pa.array(names, pa.string()).take(pa.array((keys >> np.uint64(40)).astype(np.int64)))
        return pa.RecordBatch.from_arrays([lang, pa.array((keys & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    for rows, data, offs in textvec.pieces(map(_lowered, batches), size=PIECE):
        here = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        for x in here:
            if x not in codes:
                codes[x] = len(names)
                names.append(x)
        code = np.array([codes[x] for x in here], np.uint64) << np.uint64(40)
        for packed, own in ngrams(data, offs):
            found, n = np.unique(code[own] | packed, return_counts=True)
            keys, counts = np.append(keys, found), np.append(counts, n)
        keys, counts = _summed(keys, counts) if len(keys) else (keys, counts)
        if len(keys) > HELD:
            yield out()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield out()


def learned(train: DataFrame, kept: int = KEPT) -> dict[str, np.ndarray]:
    """The most frequent n-grams of each language (ties: the smaller number)."""
    train = train.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    some = train.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(some) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = train.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a share of each language's n-grams first, so that no task ranks all of a language
    order = [F.col("n").desc(), F.col("gram")]
    share = F.pmod(F.xxhash64("gram"), F.lit(SHARES))
    some_of = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("k") <= kept)
    best = some_of.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= kept)
    top = best.select("lang", "gram").toPandas()  # kept x LANGUAGES rows at most
    found = {lang: g["gram"].to_numpy(np.int64).astype(np.uint64) for lang, g in top.groupby("lang")}
    return {r["lang"]: found.get(r["lang"], np.zeros(0, np.uint64)) for r in sorted(some, key=lambda r: r["lang"])}


def cells(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The n-gram's cell in each array."""
    h = textvec.mixed(grams * np.uint64(0xFF51AFD7ED558CCD))
    for k in range(SLICES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(CELLS - 1)).astype(np.int64)


class Filter:
    """Masks [array, group of 64 languages, cell] and, of each language, the
    share of foreign n-grams that pass for its own."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.names = list(grams)
        self.masks = np.zeros((SLICES, -(-len(grams) // 64), CELLS), np.uint64)
        self.false = np.zeros(len(grams))
        for i, g in enumerate(grams.values()):
            passes = 1.0
            for k, at in enumerate(cells(g)):
                self.masks[k, i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
                passes *= len(np.unique(at)) / CELLS
            self.false[i] = passes

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """[group, n-gram]: mask of the languages that contain the n-gram."""
        out = None
        for k, at in enumerate(cells(grams)):
            found = self.masks[k][:, at]
            out = found if out is None else out & found
        return out

    def shares(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[text, language]: corrected share of the text's n-grams that the language contains."""
        n = len(offs) - 1
        total, hits = np.zeros(n), np.zeros((n, len(self.names)))
        for grams, own in ngrams(data, offs):
            cuts = np.searchsorted(own, np.arange(n + 1))
            total += np.diff(cuts)
            found = self.containing(grams)
            for i in range(len(self.names)):
                has = ((found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.uint8)
                hits[:, i] += np.diff(np.append(0, np.cumsum(has, dtype=np.int64))[cuts])
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)


def predictions(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the score is the part that the
    language has in the shares of all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.names, UNKNOWN], pa.string())
        for rows, data, offs in textvec.pieces(map(_lowered, batches), size=PIECE):
            letters = pc.match_substring_regex(rows.column(rows.schema.get_field_index("text")), r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.full(rows.num_rows, len(model.names)), np.zeros(rows.num_rows)
            if model.names:
                share = model.shares(data, offs)
                best = np.where(letters, share.argmax(1), best)
                score = np.where(letters, share.max(1) / np.maximum(share.sum(1), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), names.take(pa.array(best)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def held_out_at(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def languages(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    held_out = held_out_at(4, 2)
    model = Filter(learned(docs.where(~held_out), kept))
    return predictions(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
