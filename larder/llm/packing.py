"""Best-fit packing by a configuration linear program over the lengths.

Documents are tokenized and cut into pieces of at most ``CAPACITY`` tokens
(only longer ones; the first piece takes the rest). The histogram of piece
lengths, ``CAPACITY`` numbers whatever the corpus, is all that reaches the
driver. Its configuration LP (how many sequences of each multiset of lengths)
is solved by multiplicative weights: lengths have prices that fall as they are
served, and the best configuration for the prices comes from a knapsack by
dynamic programming. The fractional solution is rounded down to whole
sequences that the histogram can fill, and what is left is packed best-fit,
longest first, on the histogram. A plan row tells which pieces of a length,
by their rank, go to which sequences and offsets; pieces get their ranks from
a range sort and meet the plan in a join.

Cases: a null or empty text is one token (the end mark); rows that repeat a
document are packed as often; equal lengths are ordered by id, piece and
checksum; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import running_sum, text_of, written

CAPACITY = 2048
END_ID = 0
ROUNDS = 120
CHUNK = 1 << 16


def _tokenizer(path: str):
    """The ids of ``tokenizers`` for one text, without added special tokens;
    special tokens that the text itself spells are taken as such.

    Where the vocabulary is there as ranks beside the JSON file, ``tiktoken``
    gives the same ids at several times the speed (a test compares the two);
    the tokens that the JSON adds to the vocabulary are passed on to it.
    """
    import json

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)
        return lambda text: encoding.encode(text, allowed_special="all")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``CHUNK`` characters that tokenize alone as
    they do together: cut before a space between a letter and a letter (so
    never inside a special token, which has no space)."""
    a = 0
    while len(text) - a > CHUNK:
        b = a + CHUNK
        while b < len(text) - 1 and not (text[b] == " " and text[b - 1].isalpha() and text[b + 1].isalpha()):
            b += 1
        if b >= len(text) - 1:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer)
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1)):
                ids = np.concatenate([np.array([i for part in _parts(text.as_py()) for i in encode(part)], "<u4"), np.array([END_ID], "<u4")])
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                out += [(k, j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            cols = [np.array(c, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The multiset of sizes that fits and is worth most (unbounded knapsack)."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            value = worth[c - sizes[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > worth[c - 1]:
                worth[c], choice[c] = value[k], k
                continue
        worth[c] = worth[c - 1]
    config, c = Counter(), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        config[int(choice[c])] += 1
        c -= int(sizes[choice[c]])
    return float(worth[capacity]), config


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Counter, float]]:
    """Configurations and how many sequences of each, about covering the
    histogram: multiplicative weights over the lengths, each round serving
    the best configuration for the present prices until one of its lengths
    has had a fair part of its pieces."""
    left_price = np.ones(len(sizes)) * sizes / capacity
    served, chosen = np.zeros(len(sizes)), []
    eps = math.log(len(sizes) + 1) / rounds + 0.05
    for _ in range(rounds):
        _, config = best_configuration(left_price, sizes, capacity)
        if not config:
            break
        i, a = np.array(list(config)), np.array(list(config.values()), float)
        times = float((counts[i] / a).min()) / rounds * len(i)
        chosen.append((config, times))
        served[i] += a * times
        left_price[i] *= np.exp(-eps * a * times / counts[i] * rounds / len(i))
    if not chosen:
        return []
    # scaled so that no length is served more than it has
    most = (served / counts).max()
    merged: dict[tuple, float] = defaultdict(float)
    for config, times in chosen:
        merged[tuple(sorted(config.items()))] += times / most
    return [(Counter(dict(c)), t) for c, t in sorted(merged.items(), key=lambda x: -x[1])]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((length, how often) of one sequence, longest first; number of such
    sequences), together exactly the histogram."""
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left[capacity]:
        out.append((((capacity, 1),), left.pop(capacity)))
    left = Counter({k: n for k, n in left.items() if n > 0})
    # while many pieces are left: solve, round down, go on with the rest
    for _ in range(4):
        if sum(left.values()) < 4 * len(left) or not left:
            break
        sizes = np.array(sorted(left))
        counts = np.array([left[int(s)] for s in sizes], float)
        done = 0
        for config, times in fractional(sizes, counts, capacity, rounds):
            whole = min([int(times), *(left[int(sizes[k])] // a for k, a in config.items())])
            if whole > 0 and sum(int(sizes[k]) * a for k, a in config.items()) >= capacity - capacity // 256:
                out.append((tuple(sorted(((int(sizes[k]), a) for k, a in config.items()), reverse=True)), whole))
                for k, a in config.items():
                    left[int(sizes[k])] -= a * whole
                done += whole
        left = Counter({k: n for k, n in left.items() if n > 0})
        if not done:
            break
    return out + _best_fit(left, capacity)


def _best_fit(left: Counter, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, on counts: alike sequences move together."""
    room: dict[int, list[list]] = defaultdict(list)  # free tokens -> [(contents), number]
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            free = next((r for r in range(size, capacity) if room[r]), None)
            if free is None:
                per = capacity // size
                if n >= per:
                    room[capacity - per * size].append([((size, per),), n // per])
                    n %= per
                else:
                    room[capacity - n * size].append([((size, n),), 1])
                    n = 0
                continue
            contents, number = room[free].pop()
            per = min(free // size, max(1, n // number))
            used = min(number, n // per)
            if used < number:
                room[free].append([contents, number - used])
            room[free - per * size].append([(*contents, (size, per)), used])
            n -= per * used
    return [(c, n) for groups in room.values() for c, n in groups]


def plan_rows(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per sequence, first sequence, offset):
    pieces of ``length`` with a rank in the range go to the sequences from
    the first on, ``per sequence`` side by side from the offset."""
    rows, taken, sequence = [], Counter(), 0
    for contents, number in patterns:
        offset = 0
        for size, per in contents:
            rows.append((size, taken[size], taken[size] + per * number, per, sequence, offset))
            taken[size] += per * number
            offset += size * per
        sequence += number
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = plan_rows(plan(histogram, capacity))
    table = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "_length long, _from long, _to long, _per long, _first long, _offset long")
    before, smaller = {}, 0
    for size in sorted(histogram):
        before[size], smaller = smaller, smaller + histogram[size]
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "_length long, _smaller long")
    ranked = running_sum(cut.withColumn("_one", F.lit(1)),
                         [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")], "_one", "_index", "_at", "pack-ranked")
    # both tables have a bound set by the capacity, not by the corpus
    ranked = ranked.join(F.broadcast(starts), F.col("length") == F.col("_length")).drop("_length").withColumn("_rank", F.col("_index") - 1 - F.col("_smaller"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("_first") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
                         (F.col("_offset") + at % F.col("_per") * F.col("length")).cast("long").alias("offset"))
