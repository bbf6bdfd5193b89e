"""Interning and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import importance, interning, textvec
from tests.llm import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _joined(texts):
    data = np.frombuffer(b"".join(texts) or b"", np.uint8)
    return data, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _features(text):
    w = WORD.findall((text or "").translate(brute.LOWER))
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=8))
def test_hashes_are_those_of_the_libraries(texts):
    data, offs = _joined(texts)
    start, size = offs[:-1], np.diff(offs)
    assert interning.xxhash64(data, start, size).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]
    assert interning.crc32(data, start, size).tolist() == [zlib.crc32(t) for t in texts]
    a, b = np.repeat(np.arange(len(texts)), len(texts)), np.tile(np.arange(len(texts)), len(texts))
    crc = interning.crc32(data, start, size)
    assert interning.appended(crc[a], crc[b], size[b]).tolist() == [zlib.crc32(texts[i] + texts[j]) for i in range(len(texts)) for j in range(len(texts))]


def test_hash_of_numbers():
    x = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567], np.uint64)
    assert interning.xxhash64_of_numbers(x).tolist() == [xxhash.xxh64_intdigest(int(v).to_bytes(8, "little")) for v in x]


def test_long_tails_of_crc():
    tail = b"q" * 100_003
    crc = np.array([zlib.crc32(b"head")], np.uint32)
    assert interning.appended(crc, np.array([zlib.crc32(tail)], np.uint32), np.array([len(tail)])).tolist() == [zlib.crc32(b"head" + tail)]


def test_equal_keys_of_different_words_get_slots_of_their_own():
    """All keys alike: only the bytes tell the words apart."""
    texts = [b"one", b"two", b"one", b"three", b"on", b"", b"two"]
    data, offs = _joined(texts)
    same = interning.same_bytes(data, offs[:-1], np.diff(offs))
    slot, owner = interning.place(np.full(len(texts), 7, np.uint64), same)
    assert {texts[i]: s for i, s in enumerate(slot)} == {t: slot[texts.index(t)] for t in texts}
    assert len(set(slot.tolist())) == len(set(texts)) == (owner >= 0).sum()


@pytest.mark.parametrize("segment", [1, 3, 1 << 18])
def test_ngrams(monkeypatch, texts, segment):
    monkeypatch.setattr(interning, "SEGMENT", segment)
    some = [t if segment > 3 else (t or "")[:300] for k, t in texts.items() if segment > 3 or k is None or k > 40]
    data, offs = _joined([(t or "").encode() for t in some])
    got = [Counter() for _ in some]
    counted = Counter()
    for own, slot, crc, count in interning.ngrams(textvec.LOWER[data], offs, textvec.NO_LETTER):
        for k, c in zip(own.tolist(), crc[slot].tolist()):
            got[k][c] += 1
        held = np.flatnonzero(count)
        counted.update(dict(zip(held.tolist(), [0] * len(held))))
        assert (np.bincount(slot, minlength=len(crc)) == count).all()
    for k, t in enumerate(some):
        assert got[k] == Counter(zlib.crc32(f.encode()) for f in _features(t)[1]), t


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] for r in rows}


def test_resampled(spark, docs, no_docs, rows, texts):
    target = spark.createDataFrame([(1, texts[1], "x"), (2, None, "y"), (3, "password token of the and to", "z")], "item_id int, text string, score string")
    got = importance.resampled(docs, target, percent=30).collect()
    s, t = Counter(), Counter()
    for r in rows:
        s.update(zlib.crc32(f.encode()) % 10000 for f in _features(r[1])[1])
    for x in target.collect():
        t.update(zlib.crc32(f.encode()) % 10000 for f in _features(x.text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    exp = []
    for r in rows:
        w, f = _features(r[1])
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        exp.append((r[0], len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in exp if x[1] >= 20), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    rank = [(*x, k + 1 if k < len(able) * 30 // 100 else None) for k, x in enumerate(able)] + [(*x, None) for x in exp if x[1] < 20]
    key = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(map(tuple, got), key=key) == sorted(rank, key=key)
    assert importance.resampled(no_docs, target).count() == 0
    alone = importance.resampled(docs, target.limit(0)).collect()
    assert len(alone) == len(rows) and all(r.weight >= 0 or r.n_features for r in alone)
