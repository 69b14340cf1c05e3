import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from readtrail.functions.params import label_app, level_from_action, param_int, param_str, url_param
from readtrail.operators import learners

D = dt.date
AS_OF = D(2024, 6, 1)


def level(n, puzzles=3, **more):
    params = {"level_number": n - 1, "number_of_successful_puzzles": puzzles}
    return {"name": "level_completed", "params": params, **more}


def build(raw, languages, profile):
    return learners.build_cr_user_progress(raw, languages, profile, AS_OF)


def test_params_absent_key_and_empty_list(raw_events):
    log = raw_events({"params": {"level_number": 4}}, {"no_params": True})
    got = rows(log.select(param_str("cr_user_id"), param_int("level_number"), param_str("nope")))
    assert got == [("u1", 4, None), (None, None, None)]


def test_url_param(spark):
    urls = ["https://a/?x=1&cr_lang=ZuLu&y=2", "https://a/?cr_lang=fr", "https://a/?xcr_lang=fr", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(url_param(F.col("u"), "cr_lang")).collect()] == [
        "zulu", "fr", None, None,
    ]


def test_app_label(spark, profile):
    hosts = ["appassets.androidplatform.net", "demo_kids-standalone.example.net",
             "_kids-standalone.example.net", "play.example.org", None]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [r[0] for r in df.select(label_app(F.col("h"), profile)).collect()]
    assert got == ["WBS-standalone", "demo-standalone", "CR", "CR", "CR"]


def test_action_level(spark):
    df = spark.createDataFrame([("LevelSuccess_12",), ("LevelSuccess_x",)], "a string")
    assert [r[0] for r in df.select(level_from_action(F.col("a"), lenient=True)).collect()] == [12, None]


def test_event_filter(raw_events, profile):
    host = "play.example.org"
    log = raw_events(
        {"user": "keep"},
        {"user": None},
        {"user": ""},
        {"user": "other-event", "name": "scroll"},
        {"user": "other-host", "host": "evil.example.com"},
        {"user": "bad-page", "params": {"page_location": f"http://{host}/"}},
        {"user": "longer-host", "host": f"{host}.evil"},
        {"user": "standalone", "host": "x_kids-standalone.example.net", "params": {"page_location": None}},
        {"user": "bundled", "host": "appassets.androidplatform.net", "params": {"page_location": None}},
        {"user": "null-touch", "touch": None},
        {"user": "old-touch", "touch": "2020-12-31"},
        {"user": "future-touch", "touch": "2024-06-02"},
        {"user": "null-touch-old", "touch": None, "at": "2020-12-31 10:00:00"},
        {"user": "null-host", "host": None},
    )
    got = {r[0] for r in learners.filter_cr_events(log, profile, AS_OF).select("cr_user_id").collect()}
    assert got == {"keep", "longer-host", "standalone", "bundled", "null-touch"}


def test_milestones(raw_events, languages, profile):
    log = raw_events(
        level(1, puzzles=2, user="two-puzzles"),
        level(1, user="three-puzzles"),
        level(24, user="almost"),
        level(25, user="exact", at="2024-01-12 00:00:00"),
        level(26, user="exact", at="2024-01-11 00:00:00"),
        level(27, user="fallback", at="2024-01-15 00:00:00"),
        level(28, user="fallback", at="2024-01-16 00:00:00"),
        {"user": "no-level", "name": "level_completed", "params": {"number_of_successful_puzzles": 5}},
    )
    got = rows(
        build(log, languages, profile), "cr_user_id", "max_user_level", "la_date", "ra_date", "la_flag", "ra_flag"
    )
    day = D(2024, 1, 10)
    assert got == [
        ("almost", 24, day, None, 1, 0),
        ("exact", 26, D(2024, 1, 11), D(2024, 1, 12), 1, 1),
        ("fallback", 28, D(2024, 1, 15), D(2024, 1, 15), 1, 1),
        ("no-level", 0, None, None, 0, 0),
        ("three-puzzles", 1, day, None, 1, 0),
        ("two-puzzles", 0, None, None, 0, 0),
    ]


def test_days_and_span(raw_events, languages, profile):
    log = raw_events(
        level(25, user="early-touch", touch="2024-01-01", at="2024-01-10 01:00:00"),
        level(25, user="late-touch", touch="2024-02-01", at="2024-01-10 01:00:00"),
        level(25, user="no-touch", touch=None),
    )
    got = rows(build(log, languages, profile), "cr_user_id", "days_to_ra", "active_span")
    assert got == [("early-touch", 10, 9), ("late-touch", 1, 0), ("no-touch", None, None)]


def test_game_progress_and_flags(raw_events, languages, profile):
    page = "https://play.example.org/?cr_lang="
    log = raw_events(
        level(36, user="done"),
        level(35, user="not-done"),
        {**level(5, user="zero-length"), "params": {**level(5)["params"], "page_location": page + "zulu"}},
        {**level(5, user="unknown"), "params": {**level(5)["params"], "page_location": page + "klingon"}},
        {"user": "stage", "name": "puzzle_completed"},
    )
    got = rows(build(log, languages, profile), "cr_user_id", "gpc", "gc_flag", "pc_flag", "lr_flag")
    assert got == [
        ("done", 90.0, 1, 1, 1), ("not-done", 87.5, 0, 1, 1), ("stage", 0.0, 0, 1, 1),
        ("unknown", None, 0, 1, 1), ("zero-length", None, 0, 1, 1),
    ]


def test_grain_repeats_user_statistics(raw_events, languages, profile):
    log = raw_events(
        {"country": "Kenya", "at": "2024-01-10 12:00:00"},
        {"country": "Ghana", "at": "2024-01-10 12:01:00", "name": "tapped_start"},
        {"country": "Ghana", "at": "2024-01-12 12:00:00", "name": "session_start"},
    )
    got = rows(
        build(log, languages, profile),
        "country", "furthest_event", "session_count", "engagement_event_count", "total_time_minutes",
        "avg_session_length_minutes", "last_event_date",
    )
    last = D(2024, 1, 12)
    assert got == [
        ("Ghana", "tapped_start", 2, 3, 1.0, 0.5, last),
        ("Kenya", "session_start", 2, 3, 1.0, 0.5, last),
    ]


def test_first_device_and_host(raw_events, languages, profile):
    bundled = "appassets.androidplatform.net"
    log = raw_events(
        {"device": "late", "host": "play.example.org", "at": "2024-01-11 00:00:00"},
        {"device": "early", "host": bundled, "at": "2024-01-10 23:00:00"},
        {"device": "early", "host": bundled, "at": "2024-01-12 23:00:00"},
    )
    assert rows(build(log, languages, profile), "user_pseudo_id", "app") == [("early", "WBS-standalone")]


def test_first_by_order_keeps_null(spark):
    df = spark.createDataFrame(
        [("k", D(2024, 1, 1), 5, None), ("k", D(2024, 1, 1), 6, "b")],
        "key string, event_dt date, event_timestamp bigint, v string",
    )
    assert rows(learners.first_by_order(df, ["key"], ["v"])) == [("k", None)]


def test_duplicate_language_fans_out_join_only(raw_events, languages, profile):
    events = learners.filter_cr_events(raw_events(level(3)), profile, AS_OF)
    assert learners.join_max_level(events, languages).count() == 2
    got = rows(learners.build_cr_user_progress(raw_events(level(3)), languages, profile, AS_OF),
               "max_game_level", "engagement_event_count")
    assert got == [(40, 1)]


def test_event_counts(raw_events, profile):
    log = raw_events(level(1), level(2), level(3, puzzles=1), {"name": "puzzle_completed"}, {"name": "tapped_start"})
    events = learners.filter_cr_events(log, profile, AS_OF)
    got = rows(learners.event_counts(events), "level_completed_count", "puzzle_completed_count",
               "selected_level_count", "tapped_start_count", "download_completed_count")
    assert got == [(2, 1, 0, 1, 0)]


def test_staging_gives_the_same_table(raw_events, languages, profile, tmp_path):
    log = raw_events(level(3), level(25, at="2024-01-11 00:00:00"), {"user": "u2"})
    plain = build(log, languages, profile)
    staged = learners.build_cr_user_progress(log, languages, profile, AS_OF, str(tmp_path / "flat"))
    assert rows(plain) == rows(staged)


def test_dates_do_not_depend_on_session_zone(spark, raw_events, languages, profile):
    log = raw_events({"at": "2024-01-10 23:30:00", "touch": "2024-01-09 23:30:00"})
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        got = rows(build(log, languages, profile), "first_open", "first_event_date")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(D(2024, 1, 9), D(2024, 1, 10))]
