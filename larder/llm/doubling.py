"""Substring dedup by level-wise doubling over word windows.

A word goes if a window of ``WINDOW`` consecutive words that covers it, with
the same words in the same order, also starts earlier (in a document with a
smaller id, or earlier in the same one).

Levels: windows of half the length come first. Of these only the selected ones
are counted, the least hash among those inside a full window, so every full
window has exactly one and equal windows have equal ones. Only where a
selected window is repeated are the full windows around it looked at, so the
second level holds the candidates alone; with ``WINDOW`` words as the goal no
longer level is needed, as a longer run is the union of its windows.

Each level is one exchange: a task first settles repeats among its own rows
(they need not travel, so a window that a third of all documents share sends
one row per task), the firsts are dealt out and sorted by hash, and one pass
over the sorted rows keeps two rows in memory. No group is ever collected.

A row is named by its id and a 64-bit hash of its text all along, windows by
two 64-bit hashes of their words (a false match deletes text; a pair of
corpora of 10^13 windows would hold one with a chance of about 10^-12).

Cases: a null or empty text has no words; texts shorter than a window stay;
rows with one id and one text are one document (a repeated row is no earlier
copy of itself); rows with one id and different texts are documents in the
order of the hash of their texts, each losing its own words only; rows with a
null id neither lose words nor make others lose any; ids that are no integers
are numbered in their order first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larder.llm import textvec
from larder.llm.common import running_sum, text_of, written

WINDOW = 20
#: Rows that a task settles among themselves at a time.
ROWS = 2_000_000

_FIRST = "key long, more long, doc_id long, _h long, place int, state int"


def _selected(h: np.ndarray, ptr: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash and start of the selected half window) of every full window."""
    half = window // 2
    g = textvec.grams(h, half)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    inside = np.zeros(len(h) + 1, np.int64)
    for a, b in zip(ptr[:-1], ptr[1:]):
        if b - a >= window:
            inside[a] += 1
            inside[b - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside)[:n])
    at = np.lib.stride_tricks.sliding_window_view(g, window - half + 1)[starts].argmin(1) + starts
    return starts, g[at], at


def _batch(key: np.ndarray, more: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (key, more, doc, text)), pa.array(place.astype(np.int32)),
                                       pa.array(state.astype(np.int32))], ["key", "more", "doc_id", "_h", "place", "state"])


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], settle: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Settles rows in portions of about ``ROWS``."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield from settle(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield from settle(*map(np.concatenate, zip(*held)))


def _ids(rows: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _scattered(doc: np.ndarray) -> np.ndarray:
    return textvec.mixed(doc.astype(np.uint64)).astype(np.int64)


def _half_windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows, data, offs in textvec.pieces(batches):
            h, ptr, _ = textvec.words(data, offs)
            starts, value, at = _selected(h, ptr, window)
            at, i = np.unique(at, return_index=True)
            own = np.searchsorted(ptr, at, "right") - 1
            yield value[i], _ids(rows)[own], _ids(rows, "_h")[own]

    def settle(value: np.ndarray, doc: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((text, doc, value))
        value, doc, text = value[order], doc[order], text[order]
        new = np.append(True, value[1:] != value[:-1])
        twice = ~new | np.append(~new[1:], False)
        # one row for each hash and document: state 1 if it is repeated here, 2 if another row tells its hash
        once = new | np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
        state = np.where(new, twice.astype(int), 2)
        yield _rows_with_hash(value[once], doc[once], text[once], state[once])

    return lambda batches: _gathered(parts(batches), settle)


def _rows_with_hash(value: np.ndarray, doc: np.ndarray, text: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    # what is settled is dealt out by document, the rest by hash
    deal = np.where(state == 2, _scattered(doc), value.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(value.astype(np.int64)), pa.array(doc), pa.array(text), pa.array(state.astype(np.int32))],
                                      ["deal", "value", "doc_id", "_h", "state"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by value: those whose value another row has too."""
    last, pending = None, None

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[0])], ["doc_id", "_h", "value"])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 4)])
        if pending is not None:
            rows = np.concatenate([pending, rows], 1)
        v = rows[0]
        before = np.append(last is not None and v[0] == last, v[1:] == v[:-1])
        after = np.append(v[1:] == v[:-1], False)
        keep = before | after | (rows[3] > 0)
        keep[-1] = False  # waits for what follows
        yield out(rows[:3, keep])
        pending, last = rows[:, -1:], (v[-2] if len(v) > 1 else last)
    if pending is not None and (pending[3, 0] > 0 or (last is not None and pending[0, 0] == last)):
        yield out(pending[:3])


def _full_windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows, data, offs in textvec.pieces(batches):
            h, ptr, _ = textvec.words(data, offs)
            starts, value, _ = _selected(h, ptr, window)
            own = np.searchsorted(ptr, starts, "right") - 1
            known = rows.column(rows.schema.get_field_index("values"))
            cuts = np.searchsorted(own, np.arange(rows.num_rows + 1))
            some = [np.isin(value[a:b], np.array(known[k].as_py(), np.int64).astype(np.uint64)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            some = np.concatenate(some)
            starts, own = starts[some], own[some]
            both = [textvec.grams(x, window)[starts] if len(starts) else np.zeros(0, np.uint64) for x in (h, textvec.mixed(h + textvec.PLACE))]
            yield *both, _ids(rows)[own], _ids(rows, "_h")[own], starts - ptr[own]

    def settle(value: np.ndarray, more: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((place, text, doc, more, value))
        value, more, doc, text, place = (x[order] for x in (value, more, doc, text, place))
        new = np.append(True, (value[1:] != value[:-1]) | (more[1:] != more[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        state = np.where((doc == doc[first]) & (text == text[first]) & (place == place[first]), 0, 2)
        yield _batch(np.where(state == 2, _scattered(doc), value.astype(np.int64)), more, doc, text, place, state)

    return lambda batches: _gathered(parts(batches), settle)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, document and place: those after the first of
    their key, and those settled before."""
    key, at = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, m, d, t, p, s = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
        free = s == 0
        gone = s == 2
        if free.any():
            i = np.flatnonzero(free)
            here = np.stack([d[i], t[i], p[i]])
            new = np.append((k[i][0], m[i][0]) != key, (k[i][1:] != k[i][:-1]) | (m[i][1:] != m[i][:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(i)), -1))
            least = np.where(first >= 0, here[:, first], np.full((3, 1), -1) if at is None else at[:, None])
            gone[i] = (here != least).any(0)
            key, at = (k[i][-1], m[i][-1]), least[:, -1]
        yield pa.RecordBatch.from_arrays([pa.array(d[gone]), pa.array(t[gone]), pa.array(p[gone].astype(np.int32))], ["doc_id", "_h", "place"])


def _without(window: int, covered: Callable[[list[int], int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, kept = [], []
            for text, places in zip(batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()  # splits at the six white space characters
                gone = covered(places.as_py(), len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "_h", "n_removed", "kept"])
    return strip


def _covered(window: int) -> Callable[[list[int], int], np.ndarray]:
    def covered(places: list[int], n: int) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        at = np.unique(np.array(places, np.int64))
        at = at[at + window <= n]
        edge[at] += 1
        np.subtract.at(edge, at + window, 1)
        return np.cumsum(edge)[:n] > 0
    return covered


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, _n): a number for every id, ascending with it, where ids are no integers."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sum(ids, [F.col("doc_id")], "_one", "_n", "_at", "repeat-ids").select("doc_id", "_n")


def shortened(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _h, n_removed, kept) of the documents that lose words: kept is
    their text, the words that stay joined by one space; ``_h`` is a hash of
    the text they had. ``doc_id`` must be an integer."""
    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("_h"), text_of().alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    halves = d.mapInArrow(_half_windows(window), "deal long, value long, doc_id long, _h long, state int")
    again = halves.repartition(parts, "deal").sortWithinPartitions("value").mapInArrow(_repeated, "doc_id long, _h long, value long")
    known = written(again.groupBy("doc_id", "_h").agg(F.collect_set("value").alias("values")), "repeat-halves")
    # the only time that all texts move; those without a repeated half window go no further
    due = written(d.join(known.hint("shuffle_hash"), ["doc_id", "_h"]), "repeat-texts")
    full = due.mapInArrow(_full_windows(window), _FIRST)
    later = (full.repartition(parts, "key").sortWithinPartitions("key", "more", "doc_id", "_h", "place").mapInArrow(_later, "doc_id long, _h long, place int"))
    places = written(later.groupBy("doc_id", "_h").agg(F.collect_set("place").alias("places")), "repeat-places")
    lost = due.join(places.hint("shuffle_hash"), ["doc_id", "_h"]).select("doc_id", "_h", "text", "places")
    return lost.mapInArrow(_without(window, _covered(window)), "doc_id long, _h long, n_removed long, kept string").where("n_removed > 0")


def _words_alone(also: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column(2):
                words = text.as_py().encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(batch.column(3 + k) for k in range(len(also))), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "_h", *also, "n_words", "sha"])
    return alone


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words that
    stay, joined by one space)."""
    docs = docs.select("doc_id", "text")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        ids = docs.join(numbered(docs), "doc_id", "left").select(F.col("doc_id").alias("_id"), F.col("_n").alias("doc_id"), "text")
        return _deduplicated(ids, ["_id"], window).drop("doc_id").withColumnRenamed("_id", "doc_id")
    return _deduplicated(docs, [], window)


def _deduplicated(docs: DataFrame, also: list[str], window: int) -> DataFrame:
    lost = shortened(docs, window).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_dh"), "n_removed", F.sha2("kept", 256).alias("_sha")).dropDuplicates(["_d", "_dh"])
    d = docs.select("doc_id", F.xxhash64(text_of()).alias("_h"), text_of().alias("text"), *also)
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ["doc_id", "_h", *also])
    every = d.mapInArrow(_words_alone(also), f"{kinds}, n_words long, sha string")
    return (every.join(lost, (F.col("doc_id") == F.col("_d")) & (F.col("_h") == F.col("_dh")), "left")
            .select(*also, "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("_sha", "sha").alias("kept_sha256")))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS s
  FROM t WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, count(g.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word.x, ' ' ORDER BY word.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM t LEFT JOIN word ON word.doc_id = t.doc_id LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.i = word.i
GROUP BY t.doc_id, t.w
"""
