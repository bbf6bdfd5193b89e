"""Language filters against plain sets and counts, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import language_id


def _grams(text):
    """Plain n-grams of a text as bytes: letters are a-z and all that is not ASCII."""
    out = []
    data = (text or "").lower().encode()
    words = "".join(chr(b) if language_id.LETTER[b] else " " for b in data).encode("latin-1").split(b" ")
    for w in filter(None, words):
        w = b" " + w + b" "
        out += [w[i:i + n] for n in range(2, language_id.LONGEST + 1) for i in range(len(w) - n + 1)]
    return out


def _packed(gram):
    return int.from_bytes(gram, "little")


def _arrays(texts):
    raw = [(t or "").lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(list(map(len, raw)))).astype(np.int64)


def test_ngrams(rows):
    texts = [r[1] for r in rows]
    got = [Counter() for _ in texts]
    for packed, own in language_id.ngrams(*_arrays(texts)):
        for g, k in zip(packed.tolist(), own.tolist()):
            got[k][g] += 1
    assert got == [Counter(map(_packed, _grams(t))) for t in texts]


@pytest.fixture(scope="module")
def train(rows):
    return [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]


def test_learned(docs, train, monkeypatch):
    exp = {}
    for r in train:
        if r[1] is not None and r[2] is not None:
            exp.setdefault(r[2], Counter()).update(map(_packed, _grams(r[1])))
    rows = docs.where(~language_id.held_out_at(4, 2))
    for held in (language_id.HELD, 10):  # with 10, a task passes its counts on after every batch
        monkeypatch.setattr(language_id, "HELD", held)
        got = language_id.learned(rows, kept=300)
        assert list(got) == sorted(exp)
        for lang, grams in got.items():
            best = sorted(exp[lang].items(), key=lambda x: (-x[1], x[0]))[:300]
            assert sorted(grams.tolist()) == sorted(g for g, _ in best)


def test_filter_against_sets():
    rng = np.random.default_rng(2)
    grams = {f"l{i:03}": rng.integers(1, 1 << 32, 2000, dtype=np.uint64) for i in range(70)}  # two words of 64 bits
    grams["l003"] = np.append(grams["l003"], grams["l068"][:500])
    f = language_id.Filter(grams)
    asked = np.concatenate([grams["l068"], rng.integers(1, 1 << 32, 20_000, dtype=np.uint64)])
    found = f.containing(asked)
    for i, (lang, own) in enumerate(grams.items()):
        says = (found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        true = np.isin(asked, own)
        assert says[true].all()  # none is missed
        false = (says.astype(bool) & ~true).mean()
        assert false < 3 * f.false[i] + 3e-4
        assert f.false[i] == pytest.approx((1 - np.exp(-len(own) / language_id.CELLS)) ** language_id.SLICES, rel=0.2)


def test_shares_are_corrected(monkeypatch):
    """In a crowded filter a foreign text's raw share is the false positive rate; the corrected one is about 0."""
    monkeypatch.setattr(language_id, "CELLS", 1 << 8)
    rng = np.random.default_rng(4)
    f = language_id.Filter({"a": rng.integers(1, 1 << 32, 200, dtype=np.uint64)})
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000))
    data, offs = _arrays([text])
    raw = np.concatenate([f.containing(g)[0] for g, _ in language_id.ngrams(data, offs)]).mean()
    assert raw > 0.1 and f.shares(data, offs)[0, 0] < 0.03


def test_predictions(docs, no_docs, rows, train):
    got = {}
    for r in language_id.languages(docs).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert len(got) == len({r[0] for r in rows})
    sets = {}
    for r in train:
        if r[1] is not None and r[2] is not None:
            sets.setdefault(r[2], Counter()).update(_grams(r[1]))
    sets = {k: {g for g, _ in sorted(v.items(), key=lambda x: (-x[1], _packed(x[0])))[:language_id.KEPT]} for k, v in sets.items()}
    for r in rows:
        g = got[r[0]]
        assert g.held_out == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r[1] or ""):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        grams = _grams(r[1])
        share = {k: sum(x in s for x in grams) / len(grams) for k, s in sets.items()}
        best = max(share.values())
        assert share[g.lang_pred] >= best - 0.01
        assert g.score == pytest.approx(best / max(sum(share.values()), 1e-9), abs=0.02)
    assert language_id.languages(no_docs).count() == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (None, "", None)], "doc_id int, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in language_id.languages(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(r) > 200 and (r.lang_pred == r.lang).mean() > 0.99
