import random

import pytest
from conftest import micros, rows
from pyspark.sql import functions as F

from readtrail.operators import activity

SCHEMA = "event_id bigint, user string, event_timestamp bigint"


def stream(spark, times):
    """times: list of (user, microseconds)."""
    return spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(times)], SCHEMA)


def brute_force(times, gap):
    """Per event id: (number, previous time, seconds since, session) by plain loops."""
    out = {}
    users = {u for u, _ in times}
    for user in users:
        mine = sorted((t, i) for i, (u, t) in enumerate(times) if u == user)
        session, before = 0, None
        for n, (t, i) in enumerate(mine, 1):
            since = None if before is None else (t - before) // 1_000_000
            if since is None or since > gap:
                session += 1
            out[i] = (n, before, since, session)
            before = t
    return out


@pytest.fixture(scope="module")
def mixed_times():
    rng = random.Random(7)
    times = []
    for user, size in (("busy", 400), ("calm", 40), (None, 60), ("once", 1)):
        t = micros("2024-01-10 12:00:00")
        for _ in range(size):
            t += rng.choice([0, 900_000, 30_000_000, 120_000_000, 120_900_000, 121_000_000, 500_000_000])
            times.append((user, t))
    # all at one moment, as when only a date was recorded
    times += [("dated", micros("2024-01-10 00:00:00"))] * 300
    rng.shuffle(times)
    return times


@pytest.mark.parametrize("gap", [120, 500])
def test_sessions_against_brute_force(spark, mixed_times, gap):
    want = brute_force(mixed_times, gap)
    got = activity.sessionize(stream(spark, mixed_times), "user", gap=gap)
    assert {r.event_id: r.session_id for r in got.collect()} == {i: w[3] for i, w in want.items()}


@pytest.mark.parametrize("gap", [120, 500])
def test_deltas_against_brute_force(spark, mixed_times, gap, tmp_path):
    want = brute_force(mixed_times, gap)
    df = activity.mark_sessions(
        activity.event_deltas(stream(spark, mixed_times), "user", "event_id", str(tmp_path / "order")), gap
    )
    got = {r.event_id: (r.prev_us, r.seconds_since_last) for r in df.collect()}
    assert got == {i: w[1:3] for i, w in want.items()}
    sessions = df.groupBy("user").agg(F.sum("is_new_session")).collect()
    users = {u for u, _ in mixed_times}
    last = {u: max(want[i][3] for i, (v, _) in enumerate(mixed_times) if v == u) for u in users}
    assert {r[0]: r[1] for r in sessions} == last


def test_sequence_against_brute_force(spark, mixed_times, tmp_path):
    want = brute_force(mixed_times, 120)
    ordered = activity.event_sequence(stream(spark, mixed_times), "user", "event_id", str(tmp_path / "order"))
    assert {r.event_id: r.rn for r in ordered.collect()} == {i: w[0] for i, w in want.items()}


def test_equal_times_are_numbered_by_the_tie(spark, tmp_path):
    times = [("a", 5)] * 8 + [("b", 5), ("a", 4)]
    ordered = activity.event_sequence(stream(spark, times), "user", "event_id", str(tmp_path / "order"))
    got = {r.event_id: r.rn for r in ordered.collect()}
    assert [got[i] for i in range(10)] == [2, 3, 4, 5, 6, 7, 8, 9, 1, 1]


def test_events_without_a_time_come_first(spark, tmp_path):
    times = [("a", 10_000_000), ("a", None), ("a", 500_000_000), ("a", None), (None, None), (None, 7)]
    df = stream(spark, times)
    ordered = activity.event_order(df, "user", "event_id", str(tmp_path / "order"))
    got = {r.event_id: (r.rn, r.prev_us) for r in ordered.collect()}
    assert got == {1: (1, None), 3: (2, None), 0: (3, None), 2: (4, 10_000_000), 4: (1, None), 5: (2, None)}
    sessions = {r.event_id: r.session_id for r in activity.sessionize(df, "user").collect()}
    assert sessions == {1: 1, 3: 1, 0: 2, 2: 3, 4: 1, 5: 2}


def test_gap_is_counted_in_whole_seconds(spark):
    t0 = micros("2024-01-10 12:00:00")
    times = [("a", t0), ("a", t0 + 120_000_000), ("b", t0), ("b", t0 + 120_900_000),
             ("c", t0), ("c", t0 + 121_000_000), ("d", t0), ("d", t0)]
    got = activity.session_stats_cr(stream(spark, times), "user")
    assert rows(got, "user", "session_count", "engagement_event_count") == [
        ("a", 1, 2), ("b", 1, 2), ("c", 2, 2), ("d", 1, 2),
    ]


def test_times_before_1970(spark):
    times = [("a", -200_000_000), ("a", -100_000_000), ("a", 10_000_000), ("a", 200_000_000)]
    got = activity.sessionize(stream(spark, times), "user")
    assert [r.session_id for r in got.orderBy("event_timestamp").collect()] == [1, 1, 1, 2]


def test_stats_and_event_total(spark, mixed_times):
    df = stream(spark, mixed_times)
    stats = activity.session_stats_cr(df, "user").collect()
    assert sum(r.engagement_event_count for r in stats) == len(mixed_times)
    legacy = {r.user: r for r in activity.session_stats_unity(df, "user").collect()}
    for r in stats:
        assert legacy[r.user].engagement_event_count == r.session_count
        assert legacy[r.user].total_time_minutes == r.total_time_minutes


def test_matches_session_window(spark, mixed_times):
    """Sessions equal Spark's session window, which joins events up to its length apart."""
    df = stream(spark, mixed_times).where("user IS NOT NULL").withColumn(
        "ts", F.timestamp_micros("event_timestamp")
    )
    windows = df.groupBy("user", F.session_window("ts", "120 seconds 999999 microseconds")).count()
    want = {r[0]: r[1] for r in windows.groupBy("user").agg(F.count("*")).collect()}
    got = {r.user: r.session_count for r in activity.session_stats_cr(df, "user").collect()}
    assert got == want


def test_windows_see_slices_not_events(spark):
    """A user with very many events reaches the per-user window as a handful of rows."""
    df = spark.range(200_000).select(
        F.lit("hot").alias("user"), (F.col("id") * 1_000).alias("event_timestamp")
    )
    assert activity.activity_slices(df, "user").count() == 2
