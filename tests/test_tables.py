"""Merges, array files and plan tables that become visible together."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from larder.operators import evals as ev
from larder.operators import plandocs as pd_
from larder.operators import scheduling as sc
from larder.plans import q_plandocs as qp
from larder.sources import files as fs
from larder.sources import sinks as sk
from larder.sources.manifest import Manifest
from larder.sources.merge import MergeTable

SF = "/root/testdata/sf0.001"


def _files(path):
    return {p: sorted(f for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")) for p in os.listdir(path) if p.startswith("part=")}


def test_merge_rewrites_only_touched_partitions(spark):
    path = tempfile.mkdtemp(prefix="larder-merge-") + "/t"
    t = MergeTable(spark, path, "id", 8)
    t.create(spark.range(100).select("id", F.lit("old").alias("a"), F.col("id").alias("b")))
    before = _files(path)
    upd = spark.createDataFrame([(5, "new", None), (500, "x", 1)], "id long, a string, b long")
    misses = t.update(upd, ["a", "b"])
    assert [r.id for r in misses.collect()] == [500]
    rows = {r.id: (r.a, r.b) for r in t.read().collect()}
    assert rows == {i: ("new" if i == 5 else "old", i) for i in range(100)}
    after = _files(path)
    touched = {f"part={r[0]}" for r in upd.select(t.part()).collect()}
    assert {p for p in before if before[p] != after[p]} <= touched and len(touched) < 8
    t.update(upd, ["a", "b"])  # again: the same table
    assert {r.id: (r.a, r.b) for r in t.read().collect()} == rows
    assert t.update(upd, ["a", "b"], insert=True).count() == 1
    assert {r.id for r in t.read().collect()} == {*range(100), 500}
    assert t.update(upd.limit(0), ["a"]).count() == 0 and t.read().count() == 101


def test_schedules_of_new_plans(spark):
    s = spark.createDataFrame([("a", 1, "ACTIVE"), ("b", 1, "INACTIVE"), ("c", 2, "ACTIVE")], "schedule_id string, user_id long, status string")
    due = spark.createDataFrame([(1, "a"), (1, "a")], "user_id long, schedule_id string")
    new = sc.schedules_of_new_plans(due, "2025-12-01").collect()
    assert [(r.user_id, str(r.plan_start_date), str(r.next_plan_date), str(r.plan_end_date), r.status) for r in new] == [
        (1, "2025-12-02", "2025-12-07", "2025-12-09", "ACTIVE")]
    assert {(r.schedule_id, r.status) for r in sc.closed_schedules(s, due).collect()} == {("a", "INACTIVE"), ("b", "INACTIVE")}


def test_array_file_with_broken_elements(spark):
    good = ['{"id": "a", "m": {"q": "x, {y}"}}', '{"id": "b \\"quoted\\" }", "m": {}}', '{"id": "c", "m": null}']
    path = tempfile.mkdtemp(prefix="larder-array-")
    with open(f"{path}/one.json", "w") as f:
        f.write("[\n" + ",\n".join([good[0], '{"id": "broken", "m": ', good[1], "17", '{"m": {}}', good[2]]) + "\n]\n")
    with open(f"{path}/two.json", "w") as f:
        f.write("[]")
    rows, rejects = fs.read_json_array(spark, path, fs.T.StructType().add("id", "string").add("m", fs.T.MapType(fs.T.StringType(), fs.T.StringType())))
    assert {(r.id, str(r.m)) for r in rows.collect()} == {("a", "{'q': 'x, {y}'}"), ('b "quoted" }', "{}"), ("c", "None")}
    assert sorted(r.text for r in rejects.collect()) == ["17", '{"id": "broken", "m":', '{"m": {}}']


def test_actual_intent(spark):
    df = spark.createDataFrame([('[{"action": "a"}, {"action": "b"}]', None), ("[]", None), (None, None), ("nonsense", None), ('[{"x": 1}]', None), ('[{"action": "a"}]', "failed")],
                               "plan string, error string")
    assert [r[0] for r in df.select(ev.actual_intent(F.col("plan"), F.col("error"))).collect()] == ["a", "unknown", "unknown", "unknown", "unknown", "ERROR"]


def test_suggestions_are_replaced_inside_the_summary(spark):
    plans = pd_.parse_plan(spark.createDataFrame([
        (1, '{"meal_plan": {"week_summary": {"average_daily_calories": 2000, "future_suggestions": [{"item": "old"}]}, "days": []}}'),
        (2, '{"meal_plan": {"days": []}}'), (3, '{"meal_plan": {"week_summary": {"average_daily_calories": 1}}}')], "plan_id long, document string"))
    new = spark.createDataFrame([(1, "oats"), (2, "rice")], "plan_id long, i string").select("plan_id", F.array(F.struct(F.col("i").alias("item"))).alias("items"))
    got = {r.plan_id: r.week_summary for r in pd_.replaced_suggestions(plans, new, ["plan_id"]).collect()}
    assert got == {1: '{"average_daily_calories":2000,"future_suggestions":[{"item":"oats"}]}'}


def test_plan_tables_in_one_pass(spark):
    """The tables are those of ``flatten_plan``, from one parse of the documents."""
    plans = qp.parsed(spark, SF)
    rows = pd_.plan_rows(plans, ["plan_id", "user_id"])
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    base = tempfile.mkdtemp(prefix="larder-plans-")
    assert sk.read_plan_tables(spark, base) == {}
    tables = sk.write_plan_tables(rows, base)
    for name, df in pd_.flatten_plan(plans, ["plan_id", "user_id"]).items():
        assert sorted(tables[name].columns) == sorted(df.columns)
        a, b = (x.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")) for x in (tables[name], df))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_failed_run_shows_no_table(spark, monkeypatch):
    rows = pd_.plan_rows(qp.parsed(spark, SF).limit(3), ["plan_id", "user_id"])
    base = tempfile.mkdtemp(prefix="larder-plans-")
    commit = Manifest.commit

    def fails(self, contents, keep=2):
        raise RuntimeError("lost")
    monkeypatch.setattr(Manifest, "commit", fails)
    with pytest.raises(RuntimeError):
        sk.write_plan_tables(rows, base)
    assert sk.read_plan_tables(spark, base) == {}
    monkeypatch.setattr(Manifest, "commit", commit)
    assert sk.write_plan_tables(rows, base)["meal_plans"].count() == 3
    assert sk.write_plan_tables(rows.limit(0), base)["meal_plans"].count() == 0
