from pyspark.sql import functions as F

from larder.operators import marts as m
from larder.operators import staging as st


def test_clean_category(spark):
    df = spark.createDataFrame([("123",), ("12\n",), (None,), ("",), ("Beef Products",)], "c string")
    got = [r[0] for r in df.select(m.clean_category(F.col("c"))).collect()]
    assert got == ["Uncategorized", "12\n", "Uncategorized", "Uncategorized", "Beef Products"]


def test_vegetarian_flag(spark):
    cats = ["Beef Products", "Lamb, Veal, and Game Products", "Vegetables", "SEAFOOD mix", None, "Uncategorized"]
    df = spark.createDataFrame([(c,) for c in cats], "c string")
    got = [r[0] for r in df.select(m.vegetarian_friendly(F.col("c"))).collect()]
    # NULL category: NOT IN is unknown -> FALSE (as in SQL)
    assert got == [False, False, True, False, False, True]


def test_diet_flags_and_bands(spark):
    data = [(1, 99.9, 15.0, 5.0, 25.0, 140.0), (2, 100.0, 14.9, 4.9, 25.1, None), (3, 200.0, 20.0, 1.0, 1.0, 139.0),
            (4, 400.0, 0.0, 0.0, 0.0, 0.0), (5, 400.1, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id int, calories double, protein double, total_fat double, carbohydrate double, sodium double")
    out = m.diet_flags(df).withColumn("band", m.calorie_density_band(F.col("calories"))).orderBy("id").collect()
    assert [r.band for r in out] == ["Very Low", "Low", "Low", "Moderate", "High"]
    assert [r.low_sodium for r in out] == [False, False, True, True, True]
    assert [r.high_protein for r in out] == [True, False, True, False, False]
    assert [r.low_carb for r in out] == [True, False, True, True, True]
    assert [r.low_fat for r in out] == [False, True, True, True, True]


def test_dedupe_prefers_complete_then_highest_id(spark):
    data = [(1, "apple", 1.0, 2.0), (2, "apple", None, 2.0), (3, "apple", None, None), (4, "pear", None, None),
            (5, "pear", None, None)]
    df = spark.createDataFrame(data, "fdc_id long, food_name string, fiber double, sodium double")
    got = sorted(rows(m.dedupe_food_names(df).select("food_name", "fdc_id")))
    assert got == [("apple", 1), ("pear", 5)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_macronutrient_pivot_energy_units_and_filters(spark):
    food = spark.createDataFrame([(1, "F", " Apple Pie ", "Baked"), (2, "F", "", "x"), (3, "F", "Zero", "x")],
                                 "fdc_id long, data_type string, description string, food_category string")
    nut = spark.createDataFrame([(10, "Energy", "KCAL", 1.0, 1.0), (11, "Energy", "kJ", 2.0, 2.0),
                                 (12, "Protein", "G", 3.0, 3.0), (13, "Sodium, Na", "MG", 4.0, 4.0)],
                                "id long, name string, unit_name string, nutrient_nbr double, rank_order double")
    facts = spark.createDataFrame([(1, 1, 10, 250.0), (2, 1, 11, 1046.0), (3, 1, 12, 3.5), (4, 1, 13, -1.0),
                                   (5, 3, 13, 0.0), (6, None, 12, 1.0)],
                                  "id long, fdc_id long, nutrient_id long, amount double")
    for c, t in [("data_points", "int"), ("min_value", "double"), ("max_value", "double"), ("median_value", "double"),
                 ("percent_daily_value", "double")]:
        facts = facts.withColumn(c, F.lit(None).cast(t))
    sf, sfn, sn = st.stg_food(food), st.stg_food_nutrient(facts), st.stg_nutrient(nut)
    out = {r.fdc_id: r for r in st.int_macronutrients(sf, sfn, sn).collect()}
    # K1: LIKE '%Energy%' also matches kJ, MAX takes the larger number
    assert out[1].calories == 1046.0 and out[1].protein == 3.5 and out[1].sodium is None
    assert out[1].food_name == "apple pie"
    assert 3 not in out  # only a zero amount: dropped by amount > 0 (K2)
    kcal = {r.fdc_id: r for r in st.int_macronutrients(sf, sfn, sn, energy_unit="KCAL").collect()}
    assert kcal[1].calories == 250.0
