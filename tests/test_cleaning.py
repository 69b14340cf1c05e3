import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readtrail.functions.dates import fix_dates
from readtrail.operators import cleaning, matching

D = dt.date
LAUNCH = (
    "cr_user_id string, user_pseudo_id string, country string, app_language string, "
    "first_open date, first_launch_ts timestamp, cohort_name string"
)
USERS = (
    "cr_user_id string, country string, app_language string, app string, first_open date, "
    "furthest_event string, max_user_level bigint, engagement_event_count bigint, gpc double, "
    "active_span int, last_event_date date"
)


@pytest.fixture
def launch(spark):
    def build(*items):
        out = []
        for user, device, language, *rest in items:
            day = rest[0] if rest else D(2024, 1, 5)
            country = rest[1] if len(rest) > 1 else "Kenya"
            out.append((user, device, country, language, day, dt.datetime(2024, 1, 5), None))
        return spark.createDataFrame(out, LAUNCH)

    return build


@pytest.fixture
def users(spark):
    def build(*items):
        out = []
        for item in items:
            r = {"user": "a", "country": "Kenya", "language": "english", "app": "CR",
                 "open": D(2024, 2, 2), "event": "tapped_start", "level": 0, "events": 1, "span": 0, **item}
            out.append((r["user"], r["country"], r["language"], r["app"], r["open"], r["event"],
                        r["level"], r["events"], 0.0, r["span"], D(2024, 3, 1)))
        return spark.createDataFrame(out, USERS)

    return build


def launches_of(launch_df, users_df, **options):
    out = cleaning.single_language_launch(launch_df, users_df, **options)
    assert out.columns == launch_df.columns
    return rows(out, "cr_user_id", "app_language")


def test_best_row_order(users):
    df = users(
        {"user": "level-event-wins", "event": "puzzle_completed", "level": 9, "language": "x"},
        {"user": "level-event-wins", "event": "level_completed", "level": 1, "language": "y"},
        {"user": "level-decides", "event": "level_completed", "level": 3, "language": "x"},
        {"user": "level-decides", "event": "level_completed", "level": 4, "language": "y"},
        {"user": "stage-decides", "event": "tapped_start", "language": "x"},
        {"user": "stage-decides", "event": "selected_level", "language": "y"},
        {"user": "unranked-last", "event": None, "language": "x", "events": 99},
        {"user": "unranked-last", "event": "download_completed", "language": "y"},
        {"user": "tie-by-events", "language": "x", "events": 2},
        {"user": "tie-by-events", "language": "y", "events": 5},
        {"user": "null-level-last", "level": None, "language": "x"},
        {"user": "null-level-last", "level": 0, "language": "y"},
    )
    got = rows(cleaning.best_row_cr(df), "app_language")
    assert got == [("y",)] * 6


def test_unknown_event_is_named(users):
    df = users({"event": None})
    assert rows(cleaning.best_row_cr(df), "furthest_event") == [("unknown",)]


def test_single_device_takes_language_of_progress(launch, users):
    got = launches_of(
        launch(("a", "d1", "french"), ("b", "d2", "french"), ("c", "d3", "french")),
        users({"user": "a", "language": "zulu"}, {"user": "b", "language": None}),
    )
    assert got == [("a", "zulu"), ("b", None), ("c", "french")]


def test_repeated_device_keeps_its_first_language_uncorrected(launch, users):
    got = launches_of(
        launch(("a", "d1", None, D(2024, 1, 9)), ("a", "d1", "french", D(2024, 1, 8)),
               ("a", "d1", "english", D(2024, 1, 7))),
        users({"user": "a", "language": "zulu"}),
    )
    assert got == [("a", "french")]


def test_repeated_device_without_language(launch, users):
    df = launch(("in", "d1", None), ("in", "d1", None, D(2024, 1, 6)),
                ("out", "d2", None), ("out", "d2", None, D(2024, 1, 6)))
    assert launches_of(df, users({"user": "in"})) == [("out", None)]


def test_device_shared_by_two_learners(launch, users):
    """Both learners lose all their rows and get a repeated-device row back."""
    df = launch(("a", "d1", "french"), ("b", "d1", "english"), ("b", "d9", "zulu", D(2024, 1, 30)))
    assert launches_of(df, users({"user": "x"})) == [("a", "french"), ("b", "english")]


def test_null_devices_repeat_each_other(launch, users):
    df = launch(("a", None, None), ("b", None, "french"))
    assert launches_of(df, users({"user": "a"})) == [("b", "french")]


def test_strict_match_wants_language_and_country(launch, users):
    df = launch(("a", "d1", "french", D(2024, 1, 9)), ("a", "d1", "zulu", D(2024, 1, 8)),
                ("a", "d1", "zulu", D(2024, 1, 7), "Ghana"))
    progress = users({"user": "a", "language": "zulu", "country": "Ghana"})
    assert launches_of(df, progress) == [("a", "french")]
    out = cleaning.single_language_launch(df, progress, strict_match=True)
    assert rows(out, "app_language", "country") == [("zulu", "Ghana")]


def test_first_open_of_cr_comes_from_the_launch(launch, users):
    progress = users(
        {"user": "a"}, {"user": "no-launch"}, {"user": "other", "app": "x-standalone"},
        {"user": "gone"}, {"user": "dup"},
    )
    df = launch(
        ("a", "d1", "english", D(2024, 1, 5)), ("other", "d2", "english"),
        ("gone", "d3", None), ("gone", "d3", None, D(2024, 1, 6)),
        ("dup", "d4", None, D(2024, 1, 9)), ("dup", "d4", "zulu", D(2024, 1, 8)),
    )
    got = rows(cleaning.single_language_users(df, progress), "cr_user_id", "first_open")
    assert got == [
        ("a", D(2024, 1, 5)), ("dup", D(2024, 1, 8)), ("gone", None), ("no-launch", None),
        ("other", D(2024, 2, 2)),
    ]


def test_clean_tables(spark, launch, users):
    legacy = spark.createDataFrame(
        [("u", 3, "2024-01-01", "bad", None), ("u", 5, "2024-01-02", None, None), (None, 9, None, None, None)],
        "user_pseudo_id string, max_user_level bigint, first_open string, la_date string, last_event_date string",
    )
    progress = users({"user": "a", "language": "ukranian", "span": -3},
                     {"user": "b", "language": "malgache", "span": None})
    done, old, reached = cleaning.clean_tables(
        progress, legacy, launch(("a", "d1", "arabictest"), ("z", "d2", "farsitest"))
    )
    assert rows(done, "cr_user_id", "app_language", "active_span") == [
        ("a", "ukrainian", 0), ("b", "malagasy", None),
    ]
    assert rows(old) == [("u", 5, D(2024, 1, 2), None, None)]
    assert rows(reached, "cr_user_id", "app_language") == [("a", "ukrainian"), ("z", "farsi")]


def test_one_row_per_learner(launch, users):
    df = launch(*[("a", f"d{i % 3}", "french", D(2024, 1, 1 + i)) for i in range(9)],
                *[("b", f"e{i}", "french", D(2024, 1, 1 + i)) for i in range(5)])
    progress = users(*[{"user": "a", "country": f"c{i}"} for i in range(4)], {"user": "b"})
    assert [u for u, _ in launches_of(df, progress)] == ["a", "b"]
    assert rows(cleaning.single_language_users(df, progress), "cr_user_id") == [("a",), ("b",)]


def test_fix_dates_skips_absent_columns(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("x",), (None,)], "d string")
    got = fix_dates(df, ["d", "absent"])
    assert got.columns == ["d"]
    assert [r[0] for r in got.collect()] == [None, D(2024, 2, 29), None, None]


def test_null_keys_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 9), ("a", 8), ("a", 8)], "k string, v int")
    assert rows(matching.semi_join(left, right, "k"), "v") == [(1,), (2,)]
    assert rows(matching.anti_join(left, right, "k"), "v") == [(3,)]
    once = right.distinct()
    assert rows(matching.keyed_update(left, once, "k", "v"), "v") == [(3,), (8,), (9,)]
    some = matching.keyed_update(left, once, "k", "v", when=F.col("v") > 1, unmatched_null=True)
    assert rows(some, "k", "v") == [("a", 1), ("b", None), (None, 9)]


def test_mark_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(matching.mark_duplicates(df, "k")) == [
        ("a", True), ("a", True), ("b", False), (None, True), (None, True),
    ]


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", None), ("a", 2), ("a", 1)], "k string, v int")
    assert rows(matching.dedupe(df, "k", matching.ascending("v"))) == [("a", 1)]
    assert rows(matching.dedupe(df, "k", matching.descending(F.col("v")))) == [("a", 2)]


def plain_launch_choice(rows_, best, strict):
    """The launch row of each learner by plain loops: {user: (device, language, country, day)}."""
    def first(items):
        return min(items, key=lambda r: (
            r["day"] is None, -(r["day"] or D(1970, 1, 1)).toordinal(), r["country"] is None, r["country"] or "",
            r["language"] is None, r["language"] or "", r["device"] is None, r["device"] or "",
        ))

    repeated = {r["device"] for r in rows_ if sum(s["device"] == r["device"] for s in rows_) > 1}
    out = {}
    for user in {r["user"] for r in rows_}:
        mine = [r for r in rows_ if r["user"] == user]
        dup = [r for r in mine if r["device"] in repeated]
        progress = best.get(user)
        if not dup:
            chosen = dict(first(mine))
            if progress:
                chosen["language"] = progress["language"]
        else:
            named = [r for r in dup if r["language"] is not None]
            if strict:
                named = [r for r in named if progress and r["language"] == progress["language"]
                         and r["country"] == progress["country"]]
            if named:
                chosen = first(named)
            elif progress is None:
                chosen = first(dup)
            else:
                continue
        out[user] = (chosen["device"], chosen["language"], chosen["country"], chosen["day"])
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_single_language_against_brute_force(spark, launch, users, seed, strict):
    rng = random.Random(seed)
    pick = rng.choice
    log = [
        {"user": f"u{rng.randrange(60)}", "device": pick([None, *[f"d{i}" for i in range(150)]]) if rng.random() < 0.9
         else None, "language": pick([None, "english", "french", "zulu"]), "country": pick(["Kenya", "Ghana", None]),
         "day": pick([None, D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)])}
        for _ in range(140)
    ]
    log = [dict(t) for t in {tuple(r.items()) for r in log}]
    progress = [
        {"user": f"u{i}", "country": pick(["Kenya", "Ghana"]), "language": pick([None, "english", "french"]),
         "app": pick(["CR", "x-standalone"]), "events": n}
        for i in range(0, 60, 2) for n in range(rng.randrange(1, 3))
    ]
    best = {}
    for r in progress:
        if r["user"] not in best or r["events"] > best[r["user"]]["events"]:
            best[r["user"]] = r
    launches_df = launch(*[(r["user"], r["device"], r["language"], r["day"], r["country"]) for r in log])
    users_df = users(*progress)
    want = plain_launch_choice(log, best, strict)
    out = cleaning.single_language_launch(launches_df, users_df, strict)
    got = {r.cr_user_id: (r.user_pseudo_id, r.app_language, r.country, r.first_open) for r in out.collect()}
    assert got == want
    done = cleaning.single_language_users(launches_df, users_df, strict)
    assert {r.cr_user_id: r.first_open for r in done.collect()} == {
        u: (want[u][3] if u in want else None) if r["app"] == "CR" else D(2024, 2, 2) for u, r in best.items()
    }
