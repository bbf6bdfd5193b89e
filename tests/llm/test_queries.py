"""The registered queries against their SQL, and the pipeline's stages."""

import math
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from larder.llm import queries
from larder.llm.common import written
from scripts.compare import TABLES, key as sort_key, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_all_are_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, con, key):
    df = queries.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    rel = con.execute(queries.ORACLES[key])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=sort_key)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and ids[-1]
    copies = Counter(r.doc_id for r in docs.collect())
    assert max(copies.values()) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == copies
    total = sum(r.length for r in last)
    assert len({r.sequence_id for r in last}) <= math.ceil(total / 2048) + 1
