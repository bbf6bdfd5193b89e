"""Streams equal their batch twins on a folder of files that is not in time
order, and after a stop and a restart."""

import os
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import memory as mm
from larder.operators.common import laid_out
from larder.plans import analogues as an
from larder.plans.q_streaming import SESSIONS_SQL
from larder.sources.manifest import Manifest
from larder.streaming import jobs as sj
from larder.streaming import log as log_module
from larder.streaming import pipelines as sp
from larder.streaming.log import BatchLog

SF = "/root/testdata/sf0.001"


def _same(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in a.collect()), key=key) == \
        sorted((tuple(r[c] for c in cols) for r in b.select(*cols).collect()), key=key)


def _folder(spark, name):
    return f"{tempfile.mkdtemp(prefix='larder-stream-')}/{name}.parquet"


def _add(spark, folder, name, part, parts=3):
    """One third of a table's rows, from all over its time."""
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    df.where(F.pmod(F.hash(*df.columns[:1]), F.lit(parts)) == part).coalesce(1).write.mode("append").parquet(folder)


def _sliding(spark):
    fb = an.feedback(spark, SF).where(F.col("feedback_type").isin("like", "dislike"))
    days = F.explode(F.sequence(F.date_sub(F.to_date("extracted_at"), 6), F.to_date("extracted_at")))
    return fb.select("feedback_type", days.alias("window_start")).groupBy("window_start", "feedback_type").agg(F.count(F.lit(1)).alias("n"))


def _means(spark, unit, key, out):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.groupBy(key, F.date_trunc(unit, "ts").cast("date").alias(out)).agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n"))


def _sessions(spark):
    spark.read.parquet(f"{SF}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(SESSIONS_SQL)


def _checkpoints(spark):
    m = an.messages(spark, SF)
    return mm.latest_checkpoint(m.select("thread_id", F.col("message_id").alias("checkpoint_id"), "created_at", F.col("role").alias("checkpoint_data")))


def _calls(spark):
    m = an.messages(spark, SF).where(F.col("role") == "assistant")
    return m.select("thread_id", F.lit("search_foods").alias("tool"), F.concat(F.lit("q"), (F.length("content") % 4).cast("string")).alias("query")).distinct()


TWINS = {
    "preference_memory": ("events", lambda s: mm.preference_memory(an.feedback(s, SF))),
    "thread_counters": ("conversations", lambda s: mm.thread_counters(an.messages(s, SF))),
    "latest_checkpoint": ("conversations", _checkpoints),
    "weekly_nutrition": ("events", lambda s: _means(s, "week", "user_id", "week_start")),
    "daily_trend": ("events", lambda s: _means(s, "day", "event_type", "day")),
    "dedupe_calls": ("conversations", _calls),
    "chat_sessions": ("events", _sessions),
    "feedback_sliding": ("events", _sliding),
}


@pytest.mark.parametrize("job", sorted(TWINS))
def test_stream_equals_batch_after_restart(spark, job):
    name, twin = TWINS[job]
    folder, location = _folder(spark, name), tempfile.mkdtemp(prefix="larder-stream-job-")
    run = getattr(sp, job)

    def source():
        return sj.stream_table(spark, folder.rsplit("/", 1)[0], name, max_files=1)
    _add(spark, folder, name, 2)
    _add(spark, folder, name, 0)
    before = run(source(), location=location).count()
    _add(spark, folder, name, 1)  # a new run at the same place takes only the new file
    _same(run(source(), location=location), twin(spark))
    assert before > 0
    _same(run(source(), location=location), twin(spark))


@pytest.mark.parametrize("job", ["weekly_nutrition", "daily_trend", "feedback_sliding", "dedupe_calls"])
def test_late_rows_are_kept(spark, job):
    """Files in descending time order and a short delay: all but the first are late."""
    name, twin = TWINS[job]
    folder, location = _folder(spark, name), tempfile.mkdtemp(prefix="larder-stream-job-")
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    by = "ts" if name == "events" else "conv_id"
    parts = df.withColumn("_q", F.ntile(3).over(Window.orderBy(F.col(by).desc()))).checkpoint()
    for k in (1, 2, 3):
        parts.where(F.col("_q") == k).drop("_q").coalesce(1).write.mode("append").parquet(folder)
        last = getattr(sp, job)(sj.stream_table(spark, folder.rsplit("/", 1)[0], name), location=location, delay=3600)
    _same(last, twin(spark))
    late = Manifest(spark, f"{location}/late-log").read()
    assert late["batch"] == 2 and spark.read.parquet(*[f"{location}/late-log/{f['name']}" for f in late["folders"]]).count() > 0


def test_location_is_the_same_in_every_application(spark):
    assert spark.sparkContext.applicationId not in sj.job_location(spark, "j", "/a/b")
    assert sj.job_location(spark, "j", "/a/b/") == sj.job_location(spark, "j", "/a/b") != sj.job_location(spark, "j", "/a/c")


def _log(spark, base):
    schema = spark.createDataFrame([], "k long, n long").schema
    return BatchLog(spark, base, schema, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))


def test_log_compacts_in_levels(spark, monkeypatch):
    monkeypatch.setattr(log_module, "FANOUT", 3)
    base = tempfile.mkdtemp(prefix="larder-log-")
    log = _log(spark, base)
    assert log.read().count() == 0
    for n in range(30):
        log.append(n, spark.createDataFrame([(n % 4, 1)], "k long, n long"))
        log.append(n, spark.createDataFrame([(0, 100)], "k long, n long"))  # runs again: counts once
    assert {r.k: r.n for r in log.combine(log.read()).collect()} == {0: 8, 1: 8, 2: 7, 3: 7}
    assert len(log.state()["folders"]) <= 2 * 4
    assert len(os.listdir(f"{base}/data")) <= 2 * 4 + 3 and len(os.listdir(f"{base}/manifest")) <= 4 + 2


def test_log_survives_a_crash_between_the_steps(spark, monkeypatch):
    monkeypatch.setattr(log_module, "FANOUT", 3)
    log = _log(spark, tempfile.mkdtemp(prefix="larder-log-"))
    for n in range(2):
        log.append(n, spark.createDataFrame([(1, 1)], "k long, n long"))
    commit, calls = Manifest.commit, []

    def crash(self, contents, keep=2):
        calls.append(1)
        if len(calls) == 2:  # the batch is committed, the compaction is written and not yet committed
            raise RuntimeError("lost")
        commit(self, contents, keep)
    monkeypatch.setattr(Manifest, "commit", crash)
    with pytest.raises(RuntimeError):
        log.append(2, spark.createDataFrame([(1, 1)], "k long, n long"))
    monkeypatch.setattr(Manifest, "commit", commit)
    assert [f["level"] for f in log.state()["folders"]] == [0, 0, 0] and log.combine(log.read()).collect()[0].n == 3
    log.append(2, spark.createDataFrame([(1, 50)], "k long, n long"))
    log.append(3, spark.createDataFrame([(1, 1)], "k long, n long"))
    assert log.combine(log.read()).collect()[0].n == 4


def test_stream_of_one_file(spark):
    _same(sp.thread_counters(sj.stream_table(spark, SF, "conversations")), mm.thread_counters(an.messages(spark, SF)))


def test_empty_stream_reads_back_empty(spark):
    folder = _folder(spark, "conversations")
    spark.read.parquet(f"{SF}/conversations.parquet").limit(0).write.parquet(folder)
    assert sp.thread_counters(sj.stream_table(spark, folder.rsplit("/", 1)[0], "conversations")).count() == 0


def test_sessions_of_one_user_over_many_ranges(spark):
    """Half of the events are one user's: its intervals are many ranges, and
    sessions that go over a border are stitched."""
    rng = random.Random(3)
    times = sorted(rng.sample(range(400_000), 3000))
    rows = [(1 if i % 2 else 2 + i % 7, t) for i, t in enumerate(times)]
    e = spark.createDataFrame(rows, "user_id long, t long").select("user_id", sj.moment(F.col("t") * 1_000_000).alias("ts"))
    for gap in (200, 1800):
        slots = sj.event_intervals(e, "user_id", "ts", gap)
        got = sorted((r.user_id, r.n) for r in sj.merge_intervals(slots, "user_id", gap, n_parts=9).collect())
        exp = []
        for u in {u for u, _ in rows}:
            last, n = None, 0
            for t in [t for v, t in rows if v == u]:
                if last is not None and t - last >= gap:
                    exp.append((u, n))
                    n = 0
                last, n = t, n + 1
            exp.append((u, n))
        assert got == sorted(exp)
    laid = laid_out(sj.event_intervals(e, "user_id", "ts", 200), ["user_id"], ["s", "l"], 9).where("user_id = 1")
    counts = [r["count"] for r in laid.groupBy("_pid").count().collect()]
    assert len(counts) >= 3 and max(counts) < 0.5 * sum(counts)


def test_session_slots_and_merge(spark):
    """Intervals of batches that interleave become the sessions of all events."""
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 29, 58)] + [(1, "2024-01-01 01:28:00"), (1, "2024-01-01 01:27:59"), (2, "2024-01-01 05:00:00")]
    e = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    odd = sj.event_intervals(e.where("minute(ts) % 2 = 1"), "user_id", "ts", 1800)
    even = sj.event_intervals(e.where("minute(ts) % 2 = 0"), "user_id", "ts", 1800)
    got = sj.merge_intervals(odd.unionByName(even), "user_id", 1800)
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in sj.merge_intervals(sj.event_intervals(e, "user_id", "ts", 1800), "user_id", 1800).collect()) == [1, 5]
