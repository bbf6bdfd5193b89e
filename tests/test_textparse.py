from pyspark.sql import functions as F

from larder.functions import textparse as tp


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_extract_plan_calories(spark):
    both = "**Meal Plan 1**\nBreakfast 500 kcal\nTotal: 1800 kcal\nmeal plan 2: total 999 kcal and 4001 kcal\nMEAL PLAN 3\nTotal 4000kcal"
    assert _one(spark, both, tp.extract_plan_calories) == [1800.0, 0.0, 4000.0]
    no_kcal = "Meal Plan 1: 2000 kcal\nMeal Plan 2: nothing\nMeal Plan 3: 1000 kcal"
    assert _one(spark, no_kcal, tp.extract_plan_calories) == [2000.0, 1000.0, 0.0]
    assert _one(spark, "Total Calories: 2100 kcal", tp.extract_plan_calories) == [2100.0, 0.0, 0.0]
    assert _one(spark, "no plans here", tp.extract_plan_calories) == [0.0, 0.0, 0.0]


def test_calorie_error(spark):
    df = spark.createDataFrame([([1800.0, 0.0, 2200.0], 2000.0), ([0.0, 0.0, 0.0], 2000.0)], "c array<double>, t double")
    got = [tuple(r.e) for r in tp.with_calorie_error(df, "c", "t").collect()]
    assert got == [(2000.0, 0.0, 0.0, True), (0.0, 2000.0, 100.0, False)]


def test_tool_calls(spark):
    """One call after prose, several calls in one reply, a call that never ends."""
    def call(query):
        return '{"tool": "search_foods", "query": "%s"}' % query
    replies = [(1, f"Let me look: {call('pear')}"),
               (2, f"First {call('brown lentils')}, next {call('leek')}\nlast {call('dill')}"),
               (3, call("unclosed").rstrip("}") + " and so on")]
    df = spark.createDataFrame(replies, "id int, t string")
    x = df.select("id", F.explode(tp.tool_call_candidates(F.col("t"))).alias("c")).where(F.col("c.tool") == "search_foods")
    assert sorted((r.id, r.c.query) for r in x.collect()) == [(1, "pear"), (2, "brown lentils"), (2, "dill"), (2, "leek")]


def test_judge_and_repair(spark):
    j = _one(spark, '```json\n{"accuracy": 1, "quality": 4}\n```', tp.parse_judge_json)
    assert (j.accuracy, j.quality, j.reasoning, j.parsed) == (1.0, 4.0, "No reasoning provided", True)
    bad = _one(spark, 'oops "score": 7', tp.parse_judge_json)
    assert (bad.accuracy, bad.reasoning) == (0.0, "Judge Error")
    assert _one(spark, 'oops "score": 7', tp.arena_score) == 7
    r = _one(spark, 'Here {"meal_name": "Oats", "calories": 3,} end', tp.repair_json_text)
    assert r.ok
    c = _one(spark, '{"meal_name": "Oats", // note\n "calories": 3}', tp.repair_json_text)
    assert c.ok
    assert not _one(spark, "[1, 2]", tp.repair_json_text).ok


def test_extract_json_stages(spark):
    assert _one(spark, '  [{"a": 1}]  ', tp.extract_json_from_text).stage == "whole"
    assert _one(spark, "Plan: [1, 2] done", tp.extract_json_from_text).stage == "list"
    assert _one(spark, 'x {"a": 1} y', tp.extract_json_from_text).stage == "object"
    assert _one(spark, "nothing", tp.extract_json_from_text).stage == "none"


def test_agent_text_blocks(spark):
    blocks = ('[{"thinking": "hmm"}, {"content": [{"text": "Hello"}, "plain"]}, {"tool_use": {}}, '
              '{"text": "```json\\n{\\"a\\": 1}\\n```"}]')
    assert _one(spark, blocks, tp.agent_text_blocks) == 'Hello\n\nplain\n\n{"a": 1}'
    assert _one(spark, "[]", tp.agent_text_blocks) == "No clear response found"
