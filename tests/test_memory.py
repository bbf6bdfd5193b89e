import datetime as dt

from pyspark.sql import functions as F

from larder.operators import memory as mm


def test_preference_memory_closed_form(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    fid = 0
    for key, n, timings in [("a", 1, [None]), ("b", 2, ["next_week", "this_month"]), ("c", 4, ["this_month"] + [None] * 3),
                            ("d", 6, [None] * 6)]:
        for i in range(n):
            fid += 1
            rows.append((fid, 7, "like", "food" if i < n - 1 else "dish", key, timings[i], t0 + dt.timedelta(days=i)))
    df = spark.createDataFrame(rows, "feedback_id long, user_id long, feedback_type string, entity_type string, "
                                     "entity_name string, timing string, extracted_at timestamp_ntz")
    got = {r.preference_key: r for r in mm.preference_memory(df).collect()}
    assert [got[k].confidence_score for k in "abcd"] == [0.7, 0.8, 1.0, 1.0]
    assert [got[k].frequency for k in "abcd"] == [1, 2, 4, 6]
    assert got["b"].expires_at == t0 + dt.timedelta(days=7)      # first mention's timing only (K14)
    assert got["c"].expires_at == t0 + dt.timedelta(days=30)
    assert got["a"].expires_at is None
    assert got["d"].preference_value == "dish" and got["d"].last_mentioned == t0 + dt.timedelta(days=5)


def test_thread_title(spark):
    q_early = "Can I eat oats? " + "x" * 60
    q_late = "y" * 120 + "?"
    short = "hello"
    df = spark.createDataFrame([(q_early,), (q_late,), (short,)], "m string")
    got = [r[0] for r in df.select(mm.thread_title(F.col("m"))).collect()]
    assert got == ["Can I eat oats?...", "y" * 50 + "...", "hello"]


def test_preference_buckets_and_topk(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(1, "like", f"l{i}", "food", i, now, None, True) for i in range(7)] + [
        (1, "dislike", "d1", "food", 1, now, None, True),
        (1, "temporal_preference", "thai", "cuisine", 3, now, None, True),
        (1, "temporal_preference", "soup", "food", 2, now, None, True),
        (1, "dietary_restriction", "vegan", "food", 1, now, None, True),
        (1, "like", "expired", "food", 99, now, now - dt.timedelta(days=1), True),
        (1, "like", "inactive", "food", 99, now, None, False)]
    df = spark.createDataFrame(rows, "user_id long, preference_type string, preference_key string, preference_value string, "
                                     "frequency long, last_mentioned timestamp_ntz, expires_at timestamp_ntz, is_active boolean")
    top = mm.preference_topk(mm.active_preferences(df, "2024-01-10 00:00:00"))
    got = sorted((r.bucket, r.preference_key) for r in top.collect())
    assert [k for b, k in got if b == "likes"] == ["l2", "l3", "l4", "l5", "l6"]
    assert ("cuisines", "thai") in got and ("temporal", "soup") in got and ("dietary", "vegan") in got
    assert all(k not in ("expired", "inactive") for _, k in got)


def test_turn_pairs_and_last_n(spark):
    ts = dt.datetime(2024, 1, 1)
    msgs = [(10 * 100 + t, 10, t, "user" if t % 2 == 0 else "assistant", f"message number {t} " + "z" * 40,
             ts + dt.timedelta(minutes=t // 2)) for t in range(8)]
    df = spark.createDataFrame(msgs, "message_id long, thread_id long, turn long, role string, content string, created_at timestamp_ntz")
    pairs = {r.turn: r.entity_name for r in mm.turn_pairs(df).collect()}
    assert sorted(pairs) == [1, 3, 5, 7]
    assert pairs[1] == "Response about: " + ("message number 0 " + "z" * 40)[:30] + "..."
    last = sorted((r.pos, r.turn) for r in mm.thread_context_last_n(df, 5).collect())
    assert last == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7)]
    first = sorted((r.pos, r.turn) for r in mm.thread_context_first_n(df, 3).collect())
    assert first == [(1, 0), (2, 1), (3, 2)]
