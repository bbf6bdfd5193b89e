"""Texts of an Arrow batch as numpy arrays: words and their hashes.

Work goes on in blocks of about ``BLOCK`` bytes, cut at separators, so memory
stays a small multiple of the batch whatever the lengths of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BATCH = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20_260_101))
#: A random odd 64-bit number for each byte, and the multiplier of the places in a word.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

#: Separators: white space only; or all ASCII that is no letter or digit.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NO_LETTER = np.ones(256, bool)
for _c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    NO_LETTER[ord(_c)] = False
NO_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), PLACE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``size`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(col.type)
        offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
        if len(col) == 0:
            continue
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(col):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
            b = min(b, len(col))
            yield batch.slice(a, b - a), data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            a = b


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE, fold: bool = False,
          ends: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, first word of each text and the number of all
    words, start byte of each word[, end byte of each word])."""
    table = BYTE[LOWER] if fold else BYTE
    hs, ss, es = [], [], []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n:  # back to a separator; a longer word than a block is taken whole
            gap = np.flatnonzero(separator[data[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
                break
            b = min(n, b + BLOCK)
        block = data[a:b]
        inside = ~separator[block]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        here = offs[np.searchsorted(offs, a):np.searchsorted(offs, b)] - a
        start[here] = inside[here]
        at = np.flatnonzero(inside)
        if len(at):
            first = np.flatnonzero(start[at])
            size = np.diff(np.append(first, len(at)))
            place = np.arange(len(at)) - np.repeat(first, size)
            h = np.add.reduceat(table[block[at]] * powers(int(size.max()))[place], first)
            hs.append(mixed(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            ss.append(at[first] + a)
            if ends:
                es.append(at[first] + size + a)
        a = b
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    ptr = np.searchsorted(s, offs)
    return (h, ptr, s, np.concatenate(es) if es else np.zeros(0, np.int64)) if ends else (h, ptr, s)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, as if the words were one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + h[k:len(h) - n + 1 + k])
    return out
