"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words of one text in which words ``q`` apart
are identical, ``q`` being its smallest period, that no neighbouring word
extends and that is at least ``max(LEAST, 2 * q)`` words long.

Method, for all texts of an Arrow batch at once: words become numbers that no
two texts share, so suffixes are alike only within a text. Prefix doubling
ranks them by their first 1, 2, 4, ... words (only suffixes that are not yet
alone go on), the kept ranks give the longest common prefix (LCP) of suffixes
that are neighbours in order, and these neighbours are the edges of a graph.
The edges are taken by decreasing LCP; a union-find unites the classes of
their ends, each class an ordered set of positions, the smaller one put into
the larger. Two positions that become neighbours in a united set have exactly
this LCP; if their distance is no larger, they seed a run of that period.

Every run is seeded by its first word and the word a period later: a position
of the same class between them would give the run a smaller period. For the
same reason the distance of a seed is the smallest period. A seed whose words
before both positions are equal is the inside of a run that starts earlier
and is left to it, so each run comes up once.

A text is the work of one task and needs memory in proportion to its words
(times the logarithm of its longest repeat); nothing is shuffled, so groups of
copies and hot keys of any kind weigh nothing.

Cases: a null or empty text has no words and no runs; repeated rows are judged
each for itself; an empty table gives an empty result; words of any length
are compared whole; only ``doc_id`` and ``text`` are read, so no other column
clashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import textvec
from larder.llm.common import text_of, words

LEAST = 12


def ranks_by_doubling(ids: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: a rank of every position by its first 2**k words,
    equal for positions that share them; in the last no two are equal.
    ``last``: where the text of each position ends."""
    n = len(ids)
    counts = np.bincount(ids, minlength=1)
    rank = (np.cumsum(counts) - counts)[ids]
    levels, active, span = [rank.astype(np.int32)], np.flatnonzero(counts[ids] > 1), 1
    while len(active):
        then = active + span
        inside = then < last[active]
        key = rank[active] * (n + 1) + np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, active = key[order], active[order]
        group = rank[active]
        at = np.arange(len(active))
        new = np.append(True, key[1:] != key[:-1])
        block = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        rank = rank.copy()
        rank[active] = group + np.maximum.accumulate(np.where(new, at, 0)) - block
        active = active[~(new & np.append(new[1:], True))]
        levels.append(rank.astype(np.int32))
        span *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``i`` and ``j`` of one text share."""
    lcp = np.zeros(len(i), np.int64)
    n = len(last)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        inside = np.maximum(a, b) < last[i]
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        lcp += same.astype(np.int64) << k
    return lcp


def seeds(i: np.ndarray, j: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, distance, LCP) of positions newly adjacent in their class at
    a distance within the LCP; the edges come by decreasing LCP."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], members[x] = x, [x]
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, common in zip(i.tolist(), j.tolist(), lcp.tolist()):
        a, b = root(a), root(b)
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        del members[b]
        for x in small:
            insort(large, x)
        came = set(small) if len(small) > 1 else ()
        for x in small:
            at = bisect_left(large, x)
            if at and x - large[at - 1] <= common and large[at - 1] not in came:
                yield large[at - 1], x - large[at - 1], common
            if at + 1 < len(large) and large[at + 1] - x <= common and large[at + 1] not in came:
                yield x, large[at + 1] - x, common


def runs(ids: np.ndarray, offs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. ``ids``:
    numbers of the words of all texts, none shared between texts; ``offs``:
    first word of each text and the number of all words."""
    none = np.zeros(0, np.int64)
    last = np.repeat(offs[1:], np.diff(offs))
    levels = ranks_by_doubling(ids, last) if len(ids) else [none]
    # two periods, or a period and an LCP, make a run: the LCP is half of it at least
    half = max(1, -(-least // 2))
    k = half.bit_length() - 1
    if len(levels) <= k + 1:
        return none, none, none
    shared = np.bincount(levels[k], minlength=1)[levels[k]] > 1
    some = np.flatnonzero(shared)
    some = some[np.argsort(levels[-1][some])]
    i, j = some[:-1], some[1:]
    same = levels[k][i] == levels[k][j]
    i, j = i[same], j[same]
    lcp = common_prefixes(levels, i, j, last)
    far = lcp >= half
    i, j, lcp = i[far], j[far], lcp[far]
    order = np.argsort(-lcp, kind="stable")
    found = np.array(list(seeds(i[order], j[order], lcp[order])), np.int64).reshape(-1, 3)
    start, period, common = found.T
    first = np.isin(start, offs)
    begins = first | (ids[start - 1] != ids[start + period - 1])
    whole = begins & (period + common >= least)
    start, period, common = start[whole], period[whole], common[whole]
    order = np.lexsort((period, start))
    return start[order], (period + common)[order], period[order]


def _numbers(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, numbers of the words, first word of each text."""
    split = [t.split() for t in texts]  # at the six white space characters
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=offs[1:])
    ids = np.zeros(offs[-1], np.int64)
    for w, a, b in zip(split, offs, offs[1:]):
        place = dict(zip(w, range(a, b)))
        ids[a:b] = list(map(place.__getitem__, w))
    return split, ids, offs


def _of_batch(least: int):
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in textvec.pieces(batches):
            texts = rows.column(rows.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            split, ids, offs = _numbers(texts)
            start, length, period = runs(ids, offs, least)
            cuts = np.searchsorted(start, offs)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.subtract.at(edge, start + length, 1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = [b" ".join(w) if not gone[a:b].any() else b" ".join([x for x, g in zip(w, gone[a:b]) if not g])
                    for w, a, b in zip(split, offs, offs[1:])]
            own = np.repeat(offs[:-1], np.diff(cuts))
            found = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(start - own), pa.array(length), pa.array(period)], fields=list(struct)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), found, pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "runs", "kept"])
    return find


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period of each, by start
    and period; word numbers from 0) and kept: the words that no run contains
    after its first period, joined by one space."""
    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_of_batch(least), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about one text in ten made periodic from some word on,
    as the crc32 of its id says; all others (and those without an id) as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    d = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", h.alias("h"), g.alias("g"))
    w = words(F.col("text"))
    n = F.size(w)
    a = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return d.select("doc_id", F.when(F.col("h") % 10 == 0, F.when(n > 0, periodic).otherwise("")).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Digests of ``periodic_runs``: the number of runs, the longest one (ties:
    smallest start, then period), hashes of all runs and of what is kept."""
    def best(field: str, sign: int = 1) -> Column:
        return (sign * F.col("_best")[field]).cast("long")

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.select("doc_id", "runs", "kept", longest.alias("_best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start", -1).alias("start"), best("length").alias("length"),
        best("period", -1).alias("period"), F.floor(1000 * best("length") / best("period", -1)).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


ORACLE_SQL = r"""
WITH crc AS (
  SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
given AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents JOIN crc USING (doc_id)),
cut AS (
  SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, g FROM given),
cyc AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
word AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM cyc)),
pair AS (
  SELECT u.doc_id, u.i, v.i - u.i AS q FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND 2 * (v.i - u.i) <= u.n),
isle AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM pair) GROUP BY doc_id, q, grp
  HAVING count(*) >= q AND count(*) + q >= 12),
run AS (
  SELECT * FROM isle a WHERE NOT EXISTS (
    SELECT 1 FROM isle b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
best AS (
  SELECT doc_id, s, len, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.len // b.q)::BIGINT AS exponent_milli, coalesce(l.sha, sha256('')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
