"""States of several nights against one build of the whole log."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readtrail.operators import activity, learners, legacy
from readtrail.plans import incremental
from readtrail.sources.snapshots import newest_run, published_runs

D = dt.date
DAY = 86_400_000_000
AS_OF = D(2024, 6, 1)


def stream(spark, seed, n=1500):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        user = r.choice(["a", "b", "c", None])
        day = r.choice([0, 0, 1, 1, 2, 5])
        # around midnight, so sessions go over it; and whole days of one session
        t = day * DAY + r.choice([r.randrange(600_000_000), DAY - r.randrange(600_000_000), r.randrange(DAY)])
        out.append((user, None if r.random() < 0.02 else t, D(2024, 1, 1) + dt.timedelta(days=day)))
    out += [("long", k * 100_000_000, D(2024, 1, 1)) for k in range(3000)]  # one session of three and a half days
    out += [("untimed", None, D(2024, 1, 1)), ("untimed", None, None)]
    return spark.createDataFrame(out, "user string, event_timestamp bigint, event_dt date")


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_nights_in_any_split(spark, tmp_path, seed):
    events = stream(spark, seed).cache()
    want = rows(activity.session_stats_cr(events, "user", last_day="event_dt"))
    # by chance, so that every night brings rows of all days; and by user or day
    for name, part in (("chance", F.pmod(F.xxhash64("event_timestamp", F.lit(seed)), F.lit(3))),
                       ("day", F.coalesce(F.floor(F.col("event_timestamp") / DAY), F.lit(2)) % 3)):
        base = str(tmp_path / name)
        for night in range(3):
            new = events.where(part == 2 - night)
            got = incremental.advance_sessions(new, "user", base, D(2024, 1, 1 + night), last_day="event_dt")
        columns = activity.session_stats_cr(events, "user", last_day="event_dt").columns
        assert rows(got, *columns) == want


def test_days_of_one_user_have_two_edges(spark):
    days = activity.day_sessions(activity.activity_slices(stream(spark, 3), "user"), "user")
    assert days.where(F.size("edges") > 2).count() == 0
    assert days.where("user = 'long'").select(F.sum("closed_sessions")).first()[0] == 0


def test_a_night_done_again_counts_once(spark, tmp_path):
    events, base = stream(spark, 4, 300), str(tmp_path / "t")
    half = F.pmod(F.xxhash64("event_timestamp"), F.lit(2)) == 0
    night = lambda df, day: incremental.advance_sessions(df, "user", base, D(2024, 1, day))
    night(events.where(half), 1)
    night(events, 2)  # a mistake: some rows twice
    got = night(events.where(~half), 2)
    want = activity.session_stats_cr(events, "user")
    assert rows(got, *want.columns) == rows(want)
    assert [r.version for r in published_runs(spark, f"{base}/slices")] == [2, 1]
    # an earlier night done again does not see the later one
    again = night(events.where(half), 1)
    assert rows(again, *want.columns) == rows(activity.session_stats_cr(events.where(half), "user"), *want.columns)


def test_a_night_that_dies_leaves_the_states(spark, tmp_path):
    events, base = stream(spark, 5, 200), str(tmp_path / "t")
    want = rows(incremental.advance_sessions(events, "user", base, D(2024, 1, 1)))
    broken = events.withColumn("event_timestamp", F.when(F.col("user") == "b", F.raise_error(F.lit("killed")).cast("long")).otherwise(5))
    with pytest.raises(Exception, match="killed"):
        incremental.advance_sessions(broken, "user", base, D(2024, 1, 2))
    got = incremental.advance_sessions(events.where("false"), "user", base, D(2024, 1, 3))
    assert rows(got) == want


def test_only_touched_days_are_read_again(spark, tmp_path):
    events, base = stream(spark, 6), str(tmp_path / "t")
    incremental.advance_sessions(events.where(F.col("event_timestamp") < 2 * DAY), "user", base, D(2024, 1, 1))
    late = events.where(F.col("event_timestamp") >= 5 * DAY)
    incremental.advance_sessions(late, "user", base, D(2024, 1, 2))
    assert [r.day for r in incremental._touching(spark, f"{base}/slices", D(2024, 1, 2), [5])] == [D(2024, 1, 2)]
    # a slice belongs to the day it begins in, which may be the one before
    assert newest_run(spark, f"{base}/slices").metrics["first_day"] in (4, 5)


def test_progress_of_nights(spark, raw_events, languages, profile, tmp_path):
    r = random.Random(7)
    names = ["session_start", "download_completed", "tapped_start", "selected_level", "puzzle_completed", "level_completed"]
    log = raw_events(*[
        {"at": f"2024-01-{r.randint(10, 13)} {r.randint(0, 23):02}:{r.randint(0, 59):02}:00", "user": r.choice("abcd"),
         "name": r.choice(names), "device": r.choice(["d1", "d2"]), "country": r.choice(["Kenya", None]), "touch": "2024-01-09",
         "params": {"level_number": r.randint(0, 30), "number_of_successful_puzzles": r.randint(0, 5)}} for _ in range(300)
    ])
    events = learners.filter_cr_events(log, profile, AS_OF).cache()
    want = learners.progress_table(events, languages, profile)
    for night in range(3):
        new = events.where(F.pmod(F.xxhash64("event_timestamp", "event_name"), F.lit(3)) == night)
        got = incremental.advance_progress(new, languages, profile, str(tmp_path / "cr"), D(2024, 1, 14 + night))
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_legacy_progress_of_nights(spark, raw_events, languages, profile, tmp_path):
    r = random.Random(8)
    log = raw_events(*[
        {"at": f"2024-01-{r.randint(10, 13)} {r.randint(0, 23):02}:00:00", "device": r.choice(["d1", "d2", "d3"]),
         "name": r.choice(["GamePlay", "session_start"]), "app_id": "org.example.OldReaderFrench",
         "params": {"action": r.choice(["LevelSuccess_1", "LevelSuccess_3", "LevelSuccess_25", "SegmentSuccess_1"])}} for _ in range(120)
    ])
    events = legacy.filter_unity_events(log, profile, AS_OF).drop("event_name").cache()
    want = legacy.unity_user_progress(events, languages)
    for night in range(2):
        new = events.where(F.pmod(F.xxhash64("event_timestamp"), F.lit(2)) == night)
        got = incremental.advance_legacy(new, languages, str(tmp_path / "old"), D(2024, 1, 14 + night))
    assert rows(got, *want.columns) == rows(want)
