import duckdb
import pytest

import __spark_entry__ as E
from scripts.compare import TABLES, key as sort_key, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["mart_food_categories", "mart_meal_planning", "weekly_averages", "nutrition_targets", "shopping_consolidation",
          "preference_memory", "vector_topk_batch", "box_stats", "flatten_plan", "stream_thread_counters", "fn_regex"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "category"


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 200 and set(o) <= set(q)


@pytest.mark.parametrize("key", SAMPLE)
def test_oracle_sample(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    cols = sorted(df.columns)
    s = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    rel = con.execute(E.oracle_sql()[key])
    oc = [c[0] for c in rel.description]
    o = sorted((tuple(norm(r[oc.index(c)]) for c in cols) for r in rel.fetchall()), key=sort_key)
    assert sorted(oc) == cols
    assert s == o
