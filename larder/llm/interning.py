"""N-grams of the words of an Arrow batch, interned in open-addressed tables.

A table is a power of two of slots, at most half of them taken. Keys are
xxhash64 of the bytes; all items probe at once: those whose slot is free claim
it (one of them gets it), those whose slot holds an equal item are done, the
rest go on to the next slot. Equal means equal bytes, not equal keys: words
are compared byte by byte with the word that holds the slot, and longer
n-grams by the slots of their parts, which stand for bytes already verified.

A slot carries the n-gram's crc32, computed once for each different n-gram of
the batch (from the crc32 of its words: appending is linear), and its count.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np

from larder.llm import textvec

#: Words whose n-grams are interned at a time.
SEGMENT = 1 << 18

# The primes of xxhash64, the reversed polynomial of crc32.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
POLYNOMIAL = 0xEDB88320


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(v: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(v + lane * P2, 31) * P1


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _lanes(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian numbers at these bytes."""
    size = np.dtype(kind).itemsize
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def xxhash64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the byte strings of ``data`` that start at
    ``start`` and are ``size`` bytes long."""
    at, left = start.copy(), size.astype(np.int64).copy()
    h = np.full(len(at), P5, np.uint64)
    long = np.flatnonzero(left >= 32)
    if len(long):
        v = [np.full(len(long), x % (1 << 64), np.uint64) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        on = np.arange(len(long))
        while len(on):
            i = long[on]
            for k in range(4):
                v[k][on] = _round(v[k][on], _lanes(data, at[i] + 8 * k, "<u8"))
            at[i] += 32
            left[i] -= 32
            on = on[left[i] >= 32]
        x = sum(_rotated(v[k], r) for k, r in enumerate((1, 7, 12, 18)))
        for k in range(4):
            x = (x ^ _round(np.zeros_like(x), v[k])) * P1 + P4
        h[long] = x
    h += size.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if not len(i):
            break
        h[i] = _rotated(h[i] ^ _round(np.uint64(0), _lanes(data, at[i], "<u8")), 27) * P1 + P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotated(h[i] ^ (_lanes(data, at[i], "<u4") * P1), 23) * P2 + P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        h[i] = _rotated(h[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
        at[i] += 1
        left[i] -= 1
    return _avalanche(h)


def xxhash64_of_numbers(x: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the eight bytes of each number."""
    return _avalanche(_rotated((P5 + np.uint64(8)) ^ _round(np.uint64(0), x), 27) * P1 + P4)


def same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = size[i] == size[j]
        left = np.flatnonzero(out)
        k = 0
        while len(left):
            equal = data[start[i[left]] + k] == data[start[j[left]] + k]
            out[left[~equal]] = False
            k += 1
            left = left[equal]
            left = left[size[i[left]] > k]
        return out
    return same


def place(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every item, item that owns each slot or -1): items share a
    slot if and only if ``same`` says that they are equal."""
    owner = np.full(1 << max(4, (2 * len(keys)).bit_length()), -1, np.int64)
    mask = len(owner) - 1
    slot = (keys & np.uint64(mask)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        s = slot[todo]
        free = owner[s] < 0
        owner[s[free]] = todo[free]
        first = owner[s]
        done = first == todo
        alike = np.flatnonzero(~done & (keys[first] == keys[todo]))
        done[alike] = same(first[alike], todo[alike])
        todo = todo[~done]
        slot[todo] = (slot[todo] + 1) & mask
    return slot, owner


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_BYTE = _byte_table()


def _after_zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of what 0 to 63 zero bytes make of each byte of a crc, and 64, 128, ... zero bytes."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    few = [now]
    for _ in range(64):
        now = (now >> np.uint32(8)) ^ _BYTE[now & np.uint32(255)]
        few.append(now)
    many = [few.pop()]
    while len(many) < 32:
        many.append(_looked_up(many[-1], many[-1]))
    return np.stack(few), many


def _looked_up(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


_FEW, _MANY = _after_zeros()


def appended(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of a text followed by another of ``size`` bytes, from both crc32."""
    few = size & 63
    c = _FEW[few, 0, crc & 255] ^ _FEW[few, 1, (crc >> 8) & 255] ^ _FEW[few, 2, (crc >> 16) & 255] ^ _FEW[few, 3, crc >> 24]
    rest, k = size >> 6, 0
    while rest.any():
        i = np.flatnonzero(rest & 1)
        c[i] = _looked_up(_MANY[k], c[i])
        rest, k = rest >> 1, k + 1
    return c ^ tail


def crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of many byte strings; those over 64 bytes one by one."""
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero((size > 0) & (size <= 64))
    k = 0
    while len(left):
        c[left] = (c[left] >> np.uint32(8)) ^ _BYTE[(c[left] ^ data[start[left] + k]) & np.uint32(255)]
        k += 1
        left = left[size[left] > k]
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64):
        c[i] = zlib.crc32(data[start[i]:start[i] + size[i]])
    return c


def word_places(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, size, text) of all words; no word reaches over two texts."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.append(False, inside[:-1]) & ~edge[:-1]
    after = np.append(inside[1:], False) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end - start, np.searchsorted(offs, start, "right") - 1


def ngrams(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text of every occurrence, its slot, crc32 of the n-gram in each slot,
    number of occurrences of each slot) of runs of one, two and three words
    joined by one space, a segment and a length at a time."""
    start, size, own = word_places(data, offs, separator)
    space = np.uint32(zlib.crc32(b" "))
    for a in range(0, len(start), SEGMENT):
        b = min(len(start), a + SEGMENT)
        s, z, o = start[a:b + 2], size[a:b + 2], own[a:b + 2]
        word, owner = place(xxhash64(data, s, z), same_bytes(data, s, z))
        held = np.flatnonzero(owner >= 0)
        crc = np.zeros(len(owner), np.uint32)
        crc[held] = crc32(data, s[owner[held]], z[owner[held]])
        width = np.zeros(len(owner), np.int64)
        width[held] = z[owner[held]]
        spaced = appended(crc, np.full(len(crc), space), np.ones(len(crc), np.int64))
        yield o[:b - a], word[:b - a], crc, np.bincount(word[:b - a], minlength=len(crc))
        # what came before: slot of each place, crc32 of it with a space behind
        before, before_crc = word, spaced
        for n in (2, 3):
            at = np.arange(max(0, len(s) - n + 1))
            at = at[o[at] == o[at + n - 1]]
            pair = (before[at].astype(np.uint64) << np.uint64(32)) | word[at + n - 1].astype(np.uint64)
            slot, owner = place(xxhash64_of_numbers(pair), lambda i, j: pair[i] == pair[j])
            held = np.flatnonzero(owner >= 0)
            head = (pair[owner[held]] >> np.uint64(32)).astype(np.int64)
            tail = (pair[owner[held]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            full, more = np.zeros(len(owner), np.uint32), np.zeros(len(owner), np.uint32)
            full[held] = appended(before_crc[head], crc[tail], width[tail])
            here = at < b - a
            yield o[at[here]], slot[here], full, np.bincount(slot[here], minlength=len(full))
            if n == 2:
                more[held] = appended(before_crc[head], spaced[tail], width[tail] + 1)
                before = np.zeros(len(s), np.int64)
                before[at] = slot
                before_crc = more
