"""Cases on which an easy reading of the rules gives another answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder import session
from larder.operators import meals as ml
from larder.operators import memory as mm
from larder.operators import quality as qa
from larder.operators import vectors as vx
from larder.plans.q_quality import ALLOWED_RESTRICTIONS


def test_previous_meals_are_of_active_plans(spark):
    t = dt.datetime(2024, 1, 1)
    plans = spark.createDataFrame([(1, 7, "ACTIVE", t, t, t), (2, 7, "COMPLETED", t, t, t + dt.timedelta(1)), (3, 8, "PENDING", t, t, t)],
                                  "plan_id long, user_id long, status string, start_date timestamp_ntz, end_date timestamp_ntz, created_at timestamp_ntz")
    daily = spark.createDataFrame([(10, 1, 7, 1), (20, 2, 7, 1), (30, 3, 8, 1)], "meal_id long, plan_id long, user_id long, day_number int")
    details = spark.createDataFrame([(100, 10, 1, 1, "lunch", "Soup"), (200, 20, 2, 1, "lunch", "Stew"), (300, 30, 3, 1, "lunch", "Rice")],
                                    "detail_id long, meal_id long, plan_id long, day_number int, meal_type string, meal_name string")
    got = [(r.user_id, r.meal_label) for r in ml.previous_meals(daily, details, plans).collect()]
    assert got == [(7, "Lunch: Soup")]


def test_user_context_counts_what_is_in_stock(spark):
    users = spark.createDataFrame([(7, "a"), (8, "b")], "user_id long, username string")
    stock = spark.createDataFrame([(7, 1.0), (7, 0.0), (7, -2.0), (8, 0.0)], "user_id long, quantity double")
    meals = spark.createDataFrame([], "user_id long, meal_rank int, meal_label string")
    prefs = spark.createDataFrame([], "user_id long, bucket string, bucket_rank int, preference_key string")
    got = {r.user_id: r.inventory_items for r in mm.user_context_join(users, stock, meals, prefs).collect()}
    assert got == {7: 1, 8: 0}


def test_profile_restrictions(spark):
    df = spark.createDataFrame([("Keto, Paleo, Vegan",), ("Nut-Free, Halal",), ("None",), (None,)], "t string")
    got = [r[0] for r in df.select(qa.sentinel_list_parse(F.col("t"), ALLOWED_RESTRICTIONS)).collect()]
    assert got == [["Keto", "Paleo", "Vegan"], ["Halal"], [], []]


def test_factual_accuracy_without_a_number(spark):
    df = spark.createDataFrame([("about 90 kcal", 100.0), ("not sure", 100.0), ("90", None), ("900", 100.0)], "r string, t double")
    got = [r[0] for r in df.select(vx.factual_accuracy(F.col("r"), F.col("t"))).collect()]
    assert got == [pytest.approx(0.9), None, None, 0.0]


def test_run_folders_differ(spark):
    assert session.run_dir(spark, "x") != session.run_dir(spark, "x")
