"""Plan-generation scheduling (P16, J6, W8, D11, D27, A20, A32), set-based
for all users: the per-user select-then-update loop becomes joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def due_users(schedules: DataFrame, run_date: str) -> DataFrame:
    """ACTIVE schedules with next_plan_date <= run date."""
    return schedules.where((F.col("next_plan_date") <= F.lit(run_date).cast("date"))
                           & (F.col("status") == "ACTIVE"))


def first_schedule_per_user(schedules: DataFrame, run_date: str) -> DataFrame:
    """One due schedule per user: earliest next_plan_date, then the
    smallest schedule_id (the reference's fetch order is undefined, K25)."""
    d = due_users(schedules, run_date).select("user_id", "next_plan_date", "schedule_id").distinct()
    best = F.min_by(F.struct("next_plan_date", "schedule_id"), F.struct("next_plan_date", "schedule_id"))
    return d.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.next_plan_date", "b.schedule_id")


def generation_queue_join(schedules: DataFrame, users: DataFrame) -> DataFrame:
    """ACTIVE schedules JOIN users, DISTINCT (username, date, status, user)."""
    s = schedules.where(F.col("status") == "ACTIVE").select("user_id", "next_plan_date", "status")
    u = users.select("user_id", "username")
    return s.join(u, "user_id").select("username", "next_plan_date", "status", "user_id").distinct()


def generation_queue(queue: DataFrame, today: str) -> DataFrame:
    """Overdue / Today / Tomorrow / Upcoming, with ``in_details`` for
    the rows the admin view lists (up to tomorrow)."""
    t = F.lit(today).cast("date")
    nd = F.col("next_plan_date")
    cat = (F.when(nd < t, F.lit("Overdue (Issue)")).when(nd == t, F.lit("Generating Today"))
           .when(nd == F.date_add(t, 1), F.lit("Generating Tomorrow")).otherwise(F.lit("Upcoming")))
    return queue.withColumn("queue_status", cat).withColumn("in_details", nd <= F.date_add(t, 1))


def queue_status_counts(classified: DataFrame) -> DataFrame:
    """Overdue, today and tomorrow counts (one global aggregate)."""
    s = F.col("queue_status")
    return classified.agg(
        F.count(F.when(s == "Overdue (Issue)", 1)).cast("long").alias("overdue_count"),
        F.count(F.when(s == "Generating Today", 1)).cast("long").alias("today_count"),
        F.count(F.when(s == "Generating Tomorrow", 1)).cast("long").alias("tomorrow_count"),
        F.count(F.when(F.col("in_details"), 1)).cast("long").alias("detail_rows"))


def schedule_rollforward(schedules: DataFrame, processed: DataFrame, run_date: str) -> DataFrame:
    """The processed schedule gets next = run date + 7; the other
    schedules of that user become INACTIVE; others are untouched.

    ``processed`` holds (user_id, schedule_id) of the schedules that got a
    plan; it is joined on user_id (one row per user), so the merge is a
    single shuffle join instead of per-user updates.
    """
    p = processed.select("user_id", F.col("schedule_id").alias("_done_id"))
    j = schedules.join(p, "user_id", "left")
    is_done = F.col("schedule_id") == F.col("_done_id")
    touched = F.col("_done_id").isNotNull()
    return (j.withColumn("status", F.when(touched & ~is_done, F.lit("INACTIVE")).otherwise(F.col("status")))
            .withColumn("next_plan_date", F.when(touched & is_done,
                                                 F.date_add(F.lit(run_date).cast("date"), 7))
                        .otherwise(F.col("next_plan_date")))
            .drop("_done_id"))


def new_schedule_dates(start_col="plan_start_date"):
    """D27 (new plan): next = start + 5, end = start + 7 (plan end is +6, K26)."""
    s = F.col(start_col)
    return [F.date_add(s, 5).alias("next_plan_date"), F.date_add(s, 7).alias("plan_end_date")]


def schedules_of_new_plans(planned: DataFrame, run_date: str) -> DataFrame:
    """D27 (new plan): for each user with a new plan an ACTIVE schedule that
    starts the day after the run; its id is a hash of user and start, so a
    run that is repeated makes the same rows."""
    start = F.date_add(F.lit(run_date).cast("date"), 1)
    rows = planned.select("user_id").distinct().withColumn("plan_start_date", start)
    key = F.sha2(F.concat_ws("|", "user_id", "plan_start_date"), 256)
    return rows.select(key.alias("schedule_id"), "user_id", "plan_start_date", *new_schedule_dates(), F.lit("ACTIVE").alias("status"))


def closed_schedules(schedules: DataFrame, planned: DataFrame) -> DataFrame:
    """D27 (new plan): the ids of the users' earlier schedules, INACTIVE from now on."""
    old = schedules.join(planned.select("user_id").distinct(), "user_id", "left_semi")
    return old.select("schedule_id", F.lit("INACTIVE").alias("status"))


def workflow_outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Success / failure / error counts of a batch."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).cast("long").alias("n"))
