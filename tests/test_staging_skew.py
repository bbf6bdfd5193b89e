"""J1 where one food holds half of the facts."""

from pyspark.sql import functions as F

from larder.operators import staging as st


def _inputs(spark, n):
    foods = spark.range(200).select(F.col("id").alias("fdc_id"), F.concat(F.lit("food "), "id").alias("description"), F.lit("c").alias("food_category"))
    foods = foods.withColumn("description", F.when(F.col("fdc_id") != 7, F.col("description")))
    facts = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id") % 150).cast("long").alias("fdc_id"),
                                  (F.col("id") % 5).alias("nutrient_id"), F.col("id").cast("double").alias("amount"))
    nutrients = spark.createDataFrame([(k, f"n{k}", "g") for k in range(4)], "id long, name string, unit_name string")
    return foods, facts, nutrients


def test_foods_without_facts_stay(spark):
    foods, facts, nutrients = _inputs(spark, 3000)
    got = st.food_nutrition_complete(foods, facts, nutrients)
    want = (foods.where("description IS NOT NULL").join(facts, "fdc_id", "left")
            .join(nutrients.select(F.col("id").alias("nutrient_id"), F.col("name").alias("nutrient_name"), "unit_name"), "nutrient_id", "left"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_hot_food_is_split(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        foods, facts, nutrients = _inputs(spark, 200_000)
        df = st.food_nutrition_complete(foods, facts.repartition(8), nutrients)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
