"""Data-quality queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import quality as qa
from larder.plans import analogues as an
from larder.plans.registry import register
from larder.sources.tables import table


@register("dq_unique", """SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_dq_unique(spark, d):
    return qa.dq_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dq_not_null", f"""SELECT 'fdc_id' AS column_name, CAST(COUNT(*) - COUNT(fdc_id) AS BIGINT) AS null_count FROM ({an.FEEDBACK_SQL.replace('event_id AS feedback_id', 'event_id AS fdc_id')})
UNION ALL SELECT 'timing', CAST(COUNT(*) - COUNT(timing) AS BIGINT) FROM ({an.FEEDBACK_SQL})
UNION ALL SELECT 'entity_name', CAST(COUNT(*) - COUNT(entity_name) AS BIGINT) FROM ({an.FEEDBACK_SQL})""")
def q_dq_not_null(spark, d):
    f = an.feedback(spark, d).withColumnRenamed("feedback_id", "fdc_id")
    return qa.dq_not_null(f, ["fdc_id", "timing", "entity_name"])


@register("dq_foreign_keys", f"""SELECT m.meal_id, m.plan_id FROM ({an.DAILY_MEALS_SQL}) m
  WHERE NOT EXISTS (SELECT 1 FROM ({an.MEAL_PLANS_SQL}) p WHERE p.plan_id = m.plan_id AND p.status = 'ACTIVE')""")
def q_dq_foreign_keys(spark, d):
    # days whose plan is not an ACTIVE plan (orphans w.r.t. the active set)
    plans = an.meal_plans(spark, d).where(F.col("status") == "ACTIVE")
    return qa.dq_foreign_keys(an.daily_meals(spark, d).select("meal_id", "plan_id"), plans, "plan_id", "plan_id")


# Accepted dietary restrictions for the profile form.
ALLOWED_RESTRICTIONS = ["Vegetarian", "Vegan", "Gluten-Free", "Dairy-Free", "Keto", "Paleo", "Halal", "Kosher"]


@register("sentinel_list_parse", f"""SELECT user_id, CAST(len(l) AS BIGINT) AS n_items, array_to_string(l, '|') AS items FROM (
  SELECT user_id, CASE WHEN trim(COALESCE(dietary_restrictions, '')) IN ('None', 'Any') THEN []::VARCHAR[]
    ELSE list_distinct_ordered END AS l FROM (
    SELECT user_id, dietary_restrictions, list_filter(list_transform(string_split(COALESCE(dietary_restrictions, ''), ','), lambda x: trim(x)),
      lambda x: x IN ({', '.join(repr(a) for a in ALLOWED_RESTRICTIONS)})) AS list_distinct_ordered FROM ({an.USERS_SQL})))""")
def q_sentinel_list_parse(spark, d):
    u = an.users(spark, d)
    lst = qa.sentinel_list_parse(F.col("dietary_restrictions"), ALLOWED_RESTRICTIONS)
    return u.select("user_id", F.size(lst).cast("long").alias("n_items"), F.array_join(lst, "|").alias("items"))
