import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions.mathfn import pyround
from larder.operators import nutrition as nu


def py_targets(age, gender, weight, height, activity, goal):
    bmi = round(weight / ((height / 100) ** 2), 1)
    if gender == "Male":
        bmr = 88.362 + 13.397 * weight + 4.799 * height - 5.677 * age
    else:
        bmr = 447.593 + 9.247 * weight + 3.098 * height - 4.330 * age
    mult = dict(nu.ACTIVITY_MULTIPLIERS).get(activity, 1.2)
    cal = int(bmr * mult)
    if goal == "Weight Loss":
        cal -= 500
    elif goal in ("Weight Gain", "Muscle Gain"):
        cal += 500
    protein = round(weight * 1.6, 1)
    fat = round((cal * 0.25) / 9, 1)
    carbs = round((cal - protein * 4 - fat * 9) / 4, 1)
    return bmi, cal, protein, fat, carbs


def test_targets_match_python(spark):
    users = [(1, 30, "Male", 80.5, 180.0, "Very active", "Weight Loss"),
             (2, 45, "Female", 61.3, 165.0, "Unknown level", "Muscle Gain"),
             (3, 22, "Female", 50.0, 158.0, "Sedentary", "Maintain Weight"),
             (4, 60, "Male", 95.2, 172.0, "Extremely active", "Weight Gain")]
    df = spark.createDataFrame(users, "user_id long, age int, gender string, weight_kg double, height_cm double, "
                                      "activity_level string, health_goal string")
    got = {r.user_id: r for r in nu.nutrition_targets(df, spark).collect()}
    for u in users:
        bmi, cal, p, fat, carbs = py_targets(*u[1:])
        r = got[u[0]]
        assert (r.bmi, r.daily_calories, r.daily_protein, r.daily_fat, r.daily_carbohydrate) == (bmi, cal, p, fat, carbs)
        assert r.daily_fiber == 30


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=200, max_size=200))
def test_pyround_matches_python(spark, xs):
    xs = xs + [144.95, 60.25, 2.675, 0.125, -2.5, 428.54999999999995, 448.45000000000005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2):
        got = [r[0] for r in df.select(pyround(F.col("x"), n)).collect()]
        assert got == [round(x, n) for x in xs]


def test_bmi_category_and_units(spark):
    df = spark.createDataFrame([("18.4",), ("18.5",), ("24.9",), ("25",), ("30",), ("abc",)], "b string")
    got = [r[0] for r in df.select(nu.bmi_category(F.col("b"))).collect()]
    assert got == ["Underweight", "Normal Weight", "Normal Weight", "Overweight", "Obese", "Unknown"]
    u = spark.createDataFrame([(180.0, 80.0)], "h double, w double").select(*nu.unit_system_conversion(F.col("h"), F.col("w"))).first()
    total = 180.0 / 2.54
    assert (u.feet, u.inches, u.lbs) == (int(total // 12), int(total % 12), int(80.0 * 2.20462))


def test_parse_dri_value(spark):
    df = spark.createDataFrame([("1,234 kcal/day",), ("45-60 g",), ("n/a",), ("2,000",), ("-5 g",)], "t string")
    got = [r[0] for r in df.select(nu.parse_dri_value(F.col("t"))).collect()]
    assert got == [1234.0, 45.0, 0.0, 2000.0, 0.0]


def test_alerts_thresholds(spark):
    data = [(1, 1, 2300.0, 100.0, 200.0, 50.0, 2000, 100.0, 250.0, 70.0),   # +15 % kcal -> over + suggestion
            (2, 1, 1500.0, 70.0, 320.0, 90.0, 2000, 100.0, 250.0, 70.0),    # -25 % kcal, protein low, carbs/fat high
            (3, 1, 2100.0, 100.0, 250.0, 70.0, 2000, 100.0, 250.0, 70.0),   # +5 %: nothing
            (4, 1, 2100.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0)]                # zero targets: skipped
    df = spark.createDataFrame(data, "meal_id long, user_id long, calories double, protein_g double, carbohydrates_g double, "
                                     "fat_g double, daily_calories int, daily_protein double, daily_carbohydrate double, daily_fat double")
    got = sorted((r.meal_id, r.alert_type) for r in nu.nutrition_alerts(df).collect())
    assert got == [(1, "calorie_over"), (1, "calorie_suggestion"), (2, "calorie_under"), (2, "carbs_high"),
                   (2, "fat_high"), (2, "protein_low")]
    msg = [r.message for r in nu.nutrition_alerts(df).collect() if r.alert_type == "calorie_over"][0]
    assert msg == "over by 300 kcal (15%)"


def test_goal_progress_bands(spark):
    df = spark.createDataFrame([(110.0, 100.0), (96.0, 100.0), (50.0, 100.0), (10.0, 0.0)], "a double, t double")
    pct, band = nu.goal_progress(F.col("a"), F.col("t"))
    got = [(r[0], r[1]) for r in df.select(pct, band).collect()]
    assert got == [(100.0, "above"), (96.0, "on_target"), (50.0, "below"), (0.0, "none")]


def test_macro_energy_pct(spark):
    df = spark.createDataFrame([(10.0, 5.0, 20.0, 165.0)], "p double, f double, c double, e double")
    r = df.select(*nu.macro_energy_pct(F.col("p"), F.col("f"), F.col("c"), F.col("e"))).first()
    assert (r.protein_pct, r.fat_pct, r.carbs_pct) == (round(40 / 165 * 100, 1), round(45 / 165 * 100, 1), round(80 / 165 * 100, 1))
    assert not math.isnan(r.protein_pct)


# The four recorded food rows (energy kcal, protein g,
# carbohydrate g, total fat g) and their recorded protein/fat/carbs energy
# percentages.
RECORDED_FOODS = [
    (92.0, 2.5, 19.79, 0.23, 10.9, 2.3, 86.0),
    (135.0, 6.25, 15.53, 4.76, 18.5, 31.7, 46.0),
    (105.0, 8.17, 12.29, 2.36, 31.1, 20.2, 46.8),
    (267.0, 11.77, 28.62, 10.87, 17.6, 36.6, 42.9),
]


def test_macro_energy_pct_reproduces_recorded_rows(spark):
    df = spark.createDataFrame(RECORDED_FOODS, "e double, p double, c double, f double, pp double, fp double, cp double")
    out = df.select(*nu.macro_energy_pct(F.col("p"), F.col("f"), F.col("c"), F.col("e")), "pp", "fp", "cp").collect()
    for r in out:
        assert (r.protein_pct, r.fat_pct, r.carbs_pct) == (r.pp, r.fp, r.cp)
