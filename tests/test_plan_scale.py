"""Plan documents: one assembly and one parse a row, compact lines, bounded tasks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larder.functions import schemas as sc
from larder.operators import plandocs as pd_
from larder.operators.common import spread
from larder.plans import q_meals as qm
from larder.plans import q_plandocs as qp

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """An order with lines out of order, one with null columns, one without lines, one that comes twice."""
    d, day = str(tmp_path_factory.mktemp("plans")), dt.datetime(1998, 7, 20)
    spark.createDataFrame([(1, 10, "O", 1.0, day, "x"), (2, None, "O", 1.0, None, "x"), (3, 12, "F", 1.0, day, "x"),
                           (4, 13, "F", 1.0, day, "x"), (4, 14, "F", 1.0, dt.datetime(1998, 7, 21), "x")], ORDER).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 7, 5, 3, 2.0, 10.0, 0.05, 0.0, "R", "O", day), (1, 8, 6, 1, 4.0, 20.5, 0.1, 0.0, "N", "F", day),
                           (2, None, None, None, None, None, None, None, None, None, None), (4, 9, 3, 2, 1.0, 5.0, 0.0, 0.0, "A", "O", day),
                           (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", day), (99, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", day)], LINE).write.parquet(f"{d}/lineitem.parquet")
    return d


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents(spark, tables):
    got = [(r.plan_id, json.loads(r.document)) for r in qp.plan_documents(spark, tables).collect()]
    docs = dict(got)
    assert sorted(i for i, _ in got) == [1, 2, 3, 4, 4]
    assert [(x["day"], x["day_name"], list(x["meals"])) for x in docs[1]["meal_plan"]["days"]] == [
        (1, "Monday", ["breakfast", "lunch", "dinner", "snacks"]), (3, "Wednesday", ["breakfast", "lunch", "dinner"])]
    assert docs[1]["meal_plan"]["days"][0]["meals"]["lunch"] == {"recipe": {}, "nutrition": {"calories": 28.0}}
    assert docs[1]["meal_plan"]["days"][1]["meals"]["lunch"]["meal_name"] == "lunch 5"
    assert docs[1]["recommendations"]["shopping_list_summary"] == {
        "proteins": [{"item": "part 7", "quantity_to_purchase": "2.0", "total_quantity_needed": "3.0", "unit": "g"}],
        "produce": [{"item": "part 8", "quantity_to_purchase": "4.0", "total_quantity_needed": "5.0", "unit": "g"}],
        "pantry_items": [], "total_estimated_cost": 30.5, "total_items_from_inventory": 1, "total_items_to_purchase": 2}
    assert docs[1]["future_suggestions"] == docs[1]["meal_plan"]["week_summary"]["future_suggestions"] == [
        {"item": "part 8", "category": "Produce", "suggested_quantity": 4.0, "unit": "kg"},
        {"item": "part 7", "reason": "low stock", "suggested_quantity": 2.0, "unit": "kg"}]
    assert docs[2]["user_summary"] == {"user_id": None} and docs[2]["meal_plan"]["days"][0]["meals"]["snacks"] == {"recipe": {}, "nutrition": {}}
    assert docs[3]["meal_plan"] == {"week_summary": {"future_suggestions": []}, "days": []} and "future_suggestions" not in docs[3]
    assert [sorted(x["day_name"] for x in doc["meal_plan"]["days"]) for i, doc in got if i == 4] == [["WrongName"] * 2] * 2


def test_lines_are_collected_as_plain_columns(spark, tables):
    """What is shuffled, sorted and joined are the columns; days are built after the last join."""
    plan = plan_of(qp.plan_documents(spark, tables))
    assert plan.count("collect_list(") == 2 and plan.index("dish ") < plan.index("Join")


@pytest.mark.parametrize("key", ["validate_plan", "inventory_utilization", "plan_suggestions", "week_summary", "flatten_plan",
                                 "fix_day_names", "shopping_list_items", "replace_suggestions"])
def test_a_document_is_made_and_parsed_once(spark, tables, key):
    """No filter or second column repeats the work."""
    plan = plan_of(qp.register.__globals__["QUERIES"][key](spark, tables))
    parses = plan.count("from_json(") - (key == "replace_suggestions")  # the summary that comes back
    assert parses + plan.count("parse_json(") <= 1 and plan.count("to_json(") + plan.count("WrongName") <= 3


def test_validation_keeps_columns_and_reasons(spark):
    docs = spark.createDataFrame([(1, None), (2, "[]"), (3, '{"user_summary": 1, "meal_plan": {"days": [1]}, "recommendations": [], "metadata": 0}'),
                                  (4, '{"user_summary": 1, "meal_plan": {"days": 5}, "recommendations": [], "metadata": 0}'),
                                  (5, '{"user_summary": null, "meal_plan": null, "recommendations": [], "metadata": null}'),
                                  (6, '{"user_summary": {}, "meal_plan": {"days": [{"a": [1]}, null, "x"]}, "recommendations": [], "metadata": {}}'),
                                  (7, '{"user_summary": {}, "recommendations": [], "metadata": {}}')], "plan_id long, document string")
    v = pd_.validate_plan(docs)
    assert v.columns == ["plan_id", "document", "is_valid", "reason"]
    assert {r.plan_id: (r.is_valid, r.reason) for r in v.collect()} == {
        1: (False, "not json"), 2: (False, "missing user_summary"), 3: (True, None), 4: (False, "missing days"),
        5: (False, "missing days"), 6: (True, None), 7: (False, "missing meal_plan")}


def test_schema_of_some_fields():
    some = sc.only(sc.PLAN_DOCUMENT, ["meal_plan.days.meals.recipe.difficulty_level", "meal_plan.days.day", "metadata"])
    assert some.simpleString() == ("struct<meal_plan:struct<days:array<struct<day:int,meals:map<string,struct<recipe:struct<difficulty_level:string>>>>>>,"
                                   "metadata:map<string,string>>")
    with pytest.raises(KeyError):
        sc.only(sc.PLAN_DOCUMENT, ["meal_plan.nights"])


def test_spread_tables_have_bounded_tasks(spark):
    df = spark.range(1000).select("id")
    assert spread(df, "id") is df
    parts = spread(df, "id", rows=50)
    assert parts.rdd.getNumPartitions() == 20
    assert parts.count() == 1000 and max(r[0] for r in parts.groupBy(F.spark_partition_id()).count().select("count").collect()) < 100


def test_daily_meals_of_large_tables(spark, tables, monkeypatch):
    """The sorts and hash tables by order have tasks of their own number; the rows are the same."""
    import larder.plans.analogues as an
    query = qm.q_weekly_averages
    before = sorted(map(tuple, query(spark, tables).collect()), key=str)
    monkeypatch.setattr(an, "spread", lambda df, *keys: spread(df, *keys, rows=1))
    many = query(spark, tables)
    assert "REPARTITION_BY_NUM" in plan_of(many)
    assert before and sorted(map(tuple, many.collect()), key=str) == before
