import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from readtrail.functions.params import app_suffix
from readtrail.operators import legacy

D = dt.date
AS_OF = D(2024, 6, 1)
APP = "org.example.OLDreaderFrench"


def play(action, **more):
    return {"name": "GamePlay", "app_id": APP, "params": {"action": action}, **more}


def build(raw, languages, profile, **options):
    return legacy.build_unity_user_progress(raw, languages, profile, AS_OF, **options)


def test_suffix_language(spark):
    ids = ["org.x.oldreaderFrench", "org.x.OLDREADER", "org.x.other", None]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    got = [r[0] for r in df.select(app_suffix(F.col("i"), "OldReader")).collect()]
    assert got == ["french", "", None, None]


def test_filter(raw_events, profile):
    log = raw_events(
        play("LevelSuccess_3", device="level"),
        play("SegmentSuccess_3", device="segment"),
        play("LevelFail_3", device="fail"),
        play("LevelSuccess_1", device="other-app", app_id="org.example.other"),
        play("LevelSuccess_1", device="no-touch", touch=None),
        play("LevelSuccess_1", device="old", touch="2020-12-31"),
        {"name": "user_engagement", "app_id": APP, "device": "engaged"},
        {"name": "session_start", "app_id": APP, "device": "empty", "no_params": True},
        {"name": "scroll", "app_id": APP, "device": "scroll"},
    )
    got = rows(legacy.filter_unity_events(log, profile, AS_OF).select("user_pseudo_id").distinct())
    assert got == [("engaged",), ("level",), ("segment",)]


def test_plain_events_count_once_per_parameter(raw_events, languages, profile):
    start = {"name": "session_start", "app_id": APP, "params": {"a": "1"}}  # 3 parameters in all
    empty = {"name": "session_start", "app_id": APP, "no_params": True}
    log = raw_events(start, empty)
    assert rows(build(log, languages, profile), "total_sessions", "furthest_event") == [
        (3, "session_start")
    ]
    assert rows(build(log, languages, profile, dedupe_events=True), "total_sessions") == [(2,)]


def test_rollup(raw_events, languages, profile):
    log = raw_events(
        play("LevelSuccess_25", at="2024-01-12 10:00:00", touch="2024-01-02", version="1.1"),
        play("LevelSuccess_26", at="2024-01-11 10:00:00", touch="2024-01-03", version="1.2", country="Zambia"),
        play("SegmentSuccess_4", at="2024-01-11 10:01:00", touch="2024-01-03", version="1.0"),
    )
    r = build(log, languages, profile).first()
    assert (r.first_open, r.country, r.app_language, r.app_version) == (D(2024, 1, 2), "Zambia", "french", "1.2")
    assert (r.max_user_level, r.max_game_level, r.gpc) == (26, 30, 26 / 30 * 100)
    assert (r.la_date, r.ra_date, r.days_to_ra) == (D(2024, 1, 11), D(2024, 1, 12), 10)
    assert (r.first_event_date, r.last_event_date, r.active_span) == (D(2024, 1, 11), D(2024, 1, 12), 1)
    assert (r.engagement_event_count, r.total_time_minutes) == (2, 1.0)
    assert (r.level_completed_count, r.total_sessions, r.furthest_event) == (2, 0, "level_completed")
    assert (r.la_flag, r.ra_flag, r.gc_flag, r.lr_flag, r.skipped_level) == (1, 1, 0, 1, True)
    assert (r.app, r.started_in_offline_mode) == ("Unity", None)


def test_skipped_levels(raw_events, languages, profile):
    plays = {"gap": [1, 2, 4], "whole": [1, 2, 3, 3], "zero": [0], "from-two": [2, 3]}
    log = raw_events(*[play(f"LevelSuccess_{n}", device=d) for d, ns in plays.items() for n in ns])
    want = [("from-two", True), ("gap", True), ("whole", False), ("zero", False)]
    assert rows(build(log, languages, profile), "user_pseudo_id", "skipped_level") == want
    events = legacy.filter_unity_events(log, profile, AS_OF)
    assert rows(legacy.level_skips(events), "user_pseudo_id", "skipped_level") == want


def test_no_user_id(raw_events, languages, profile):
    log = raw_events(play("LevelSuccess_3", device=None))
    r = build(log, languages, profile).first()
    assert (r.max_user_level, r.skipped_level, r.engagement_event_count) == (3, False, None)


def test_equal_dimension_rows_collapse_but_two_lengths_fan_out(spark, raw_events, profile):
    log = raw_events(play("LevelSuccess_3"))
    same = spark.createDataFrame([("french", 30), ("french", 30)], "app_language string, max_level bigint")
    two = spark.createDataFrame([("french", 30), ("french", 20)], "app_language string, max_level bigint")
    assert rows(build(log, same, profile), "level_completed_count", "max_game_level") == [(1, 30)]
    assert rows(build(log, two, profile), "level_completed_count", "max_game_level") == [(2, 30)]


def test_union_sources_keeps_duplicates(raw_events):
    log = raw_events(play("LevelSuccess_3"))
    assert legacy.union_sources([log, log, log]).count() == 3
