import datetime as dt

import pytest
from conftest import rows

from readtrail.functions.dates import date_range, export_day
from readtrail.operators import cohorts, funnel
from readtrail.operators.cohorts import CohortFilter, LearnerTables
from readtrail.plans import reports

D = dt.date
PROGRESS = (
    "cr_user_id string, user_pseudo_id string, country string, app_language string, app string, "
    "first_open date, furthest_event string, max_user_level bigint, gpc double"
)
LAUNCHES = "cr_user_id string, country string, app_language string, first_open date"
LEGACY = (
    "user_pseudo_id string, country string, app_language string, app string, first_open date, "
    "furthest_event string, max_user_level bigint, gpc double"
)


@pytest.fixture(scope="module")
def progress(spark):
    def build(*items):
        out = []
        for i, item in enumerate(items):
            r = {"user": f"u{i}", "country": "Kenya", "language": "english", "app": "CR",
                 "open": D(2024, 1, 5), "event": "session_start", "level": 0, "gpc": 0.0, **item}
            out.append((r["user"], f"d{i}", r["country"], r["language"], r["app"], r["open"],
                        r["event"], r["level"], r["gpc"]))
        return spark.createDataFrame(out, PROGRESS)

    return build


def one(df, *columns):
    out = rows(df, *columns)
    assert len(out) == 1
    return out[0]


def test_stage_or_later(progress):
    events = ["session_start", "download_completed", "tapped_start", "selected_level",
              "puzzle_completed", "level_completed", None]
    df = progress(*[{"event": e} for e in events])
    totals = one(funnel.cohort_totals(df), "LR", "DC", "TS", "SL", "PC")
    assert totals == (7, 5, 4, 3, 2)
    assert list(totals) == sorted(totals, reverse=True)


def test_level_thresholds(progress):
    df = progress({"level": 0, "gpc": 95.0}, {"level": 1, "gpc": 90.0}, {"level": 25, "gpc": 89.9},
                  {"level": 30, "gpc": None}, {"level": None})
    assert one(funnel.cohort_totals(df), "LA", "RA", "GC") == (3, 2, 1)


def test_funnel_by_group(spark, progress):
    df = progress(
        {"user": "a", "event": "level_completed", "level": 10, "gpc": 25.0},
        {"user": "a", "event": "level_completed", "level": 38, "gpc": 95.0, "language": "english"},
        {"user": "b", "event": "tapped_start"},
        {"user": "c", "language": "zulu", "event": "level_completed", "level": 5, "gpc": None},
        {"user": "d", "language": "french", "event": "puzzle_completed"},
        {"user": "e", "language": "silent"},
        {"user": "f", "language": None, "event": "level_completed", "level": 9},
    )
    launches = spark.createDataFrame(
        [("a", "Kenya", "english", None), ("a", "Kenya", "english", None), ("x", "Kenya", "english", None),
         ("y", "Kenya", "launch-only", None), ("c", "Kenya", "zulu", None)], LAUNCHES)
    table = funnel.funnel_by_group(df, launches, "app_language", "CR")
    got = {r.app_language: r for r in table.collect()}
    assert sorted(got) == ["english", "french", "zulu"]
    e = got["english"]
    assert (e.LR, e.DC, e.TS, e.SL, e.PC, e.LA, e.RA, e.GC) == (2, 3, 3, 2, 2, 2, 1, 1)
    assert (e.LR_pct, e.TS_pct, e.RA_pct) == (100.0, 150.0, 50.0)
    # learner a has two rows: GPP is over rows, GCA over learners
    assert (e.GPP, e.GPP_pct, e.GCA, e.GCA_pct) == (60.0, 60.0, 100.0, 100.0)
    z, f = got["zulu"], got["french"]
    assert (z.LR, z.GPP, z.GCA) == (1, 0.0, 0.0)
    # no learner reached: percentages are unknown, as are means over no learner
    assert (f.LR, f.PC, f.PC_pct, f.LR_pct, f.GPP, f.GCA) == (0, 1, None, 100.0, None, None)
    assert "DC" not in funnel.funnel_by_group(df, launches, "app_language", "CR", min_funnel=True).columns


def test_completion_rounds_half_to_even(progress):
    df = progress(*[
        {"event": "level_completed", "level": 1, "gpc": 95.0 if i == 0 else 1.0} for i in range(800)
    ])
    assert one(funnel.funnel_by_group(df, None, "country", "x-standalone"), "GCA") == (0.12,)


def test_launch_cohort_gives_lr_only(spark):
    df = spark.createDataFrame(
        [("a", "Kenya", None, None), ("a", "Kenya", None, None), ("b", "Kenya", "zulu", None)], LAUNCHES)
    assert rows(funnel.funnel_by_group(df, by="app_language", app="CR")) == [
        ("zulu", 1, 100.0), (None, 1, 100.0),
    ]


def test_empty_cohort_gives_empty_table(progress):
    df = progress({}).where("false")
    assert funnel.funnel_by_group(df, None, "country", "CR").count() == 0
    assert funnel.cohort_totals(df).first().LR == 0
    assert rows(reports.funnel_steps(df, None, "CR", "compact"), "n") == [(0,)] * 5


def test_sorted_and_top(progress):
    events = ["level_completed", "puzzle_completed"]
    df = progress(*[
        {"country": f"c{i:02}", "event": events[i % 2], "level": (1 - i % 2) * (i + 1), "gpc": float(i)}
        for i in range(12) for _ in range(i + 1)
    ])
    table = funnel.funnel_by_group(df, None, "country", "CR", min_funnel=True)
    by_gpp = [r.country for r in funnel.sorted_funnel(table, " gpp ").collect()]
    assert by_gpp[:3] == ["c10", "c08", "c06"]
    # groups without an acquired learner have no GPP and stay last both ways
    up = [r.country for r in funnel.sorted_funnel(table, "GPP", ascending=True).collect()]
    assert up[0] == "c00" and up[6:] == by_gpp[6:]
    top = funnel.top(table, "LR")
    assert [r.country for r in top.collect()] == [f"c{i:02}" for i in range(11, 1, -1)]
    with pytest.raises(KeyError):
        funnel.sorted_funnel(table, "DC")


@pytest.fixture(scope="module")
def tables(spark, progress):
    users = progress(
        {"user": "a", "event": "level_completed", "level": 36, "gpc": 90.0},
        {"user": "a", "event": "level_completed", "level": 4, "gpc": 10.0, "country": "Ghana"},
        {"user": "b", "language": None},
        {"user": "c", "app": "demo-standalone", "event": "puzzle_completed"},
        {"user": "late", "open": D(2024, 3, 1)}, {"user": "no-day", "open": None},
    )
    launches = spark.createDataFrame([
        ("a", "Kenya", "english", D(2024, 1, 1)), ("b", "Kenya", None, D(2024, 1, 31)),
        ("z", "Ghana", "zulu", D(2024, 1, 9)), ("w", "Ghana", "zulu", D(2024, 2, 1))], LAUNCHES)
    legacy = spark.createDataFrame([
        ("o1", "Kenya", "zulu", "Unity", D(2024, 1, 3), "level_completed", 30, 95.0),
        ("o2", "Kenya", "zulu", "Unity", D(2024, 1, 3), "level_completed", 1, None),
        ("o3", "Kenya", "zulu", "Unity", D(2024, 1, 3), None, 0, None)], LEGACY)
    return LearnerTables(users, legacy, launches)


JANUARY = CohortFilter((D(2024, 1, 1), D(2024, 1, 31)))


def ids(df):
    key = "cr_user_id" if "cr_user_id" in df.columns else "user_pseudo_id"
    return sorted(r[0] for r in df.select(key).collect())


def test_router(tables):
    assert ids(cohorts.select_users(tables, "Unity")) == ["o1", "o2", "o3"]
    assert ids(cohorts.select_users(tables, ["demo-standalone"])) == ["c"]
    assert ids(cohorts.select_users(tables, "CR", "LR")) == ["a", "b", "w", "z"]
    assert len(ids(cohorts.select_users(tables, "CR"))) == 6


def test_cohort_filters(tables):
    users = tables.progress
    assert ids(cohorts.cohort(users, JANUARY, "CR")) == ["a", "a", "b"]
    assert ids(cohorts.cohort(users, CohortFilter(None, "All", ["All"]), ["All"])) == [
        "a", "a", "b", "c", "late", "no-day"]
    assert len(ids(cohorts.cohort(users, CohortFilter(languages=[], countries=[]), "All"))) == 6
    assert ids(cohorts.cohort(users, CohortFilter(countries=["Ghana"]))) == ["a"]
    assert ids(cohorts.cohort(users, CohortFilter(languages=["zulu"]))) == []
    assert ids(cohorts.cohort(users, CohortFilter(languages=["zulu", None]))) == ["b"]
    renamed = users.withColumnRenamed("app_language", "language").drop("app")
    assert ids(cohorts.cohort(renamed, CohortFilter(languages=[None]), "CR")) == ["b"]


def test_launch_cohort_only_for_cr_alone(tables):
    assert ids(cohorts.filtered_cohort(tables, ["CR"], JANUARY)[1]) == ["a", "b", "z"]
    assert cohorts.filtered_cohort(tables, "Unity", JANUARY)[1] is None


def test_app_funnel(tables):
    table = funnel.app_funnel(["CR", "Unity", "demo-standalone", "none-standalone"], tables, JANUARY, "large")
    got = {r.app: r for r in table.collect()}
    cr, old, demo, none = (got[a] for a in ["CR", "Unity", "demo-standalone", "none-standalone"])
    assert (cr.LR, cr.DC, cr.PC, cr.LA, cr.RA, cr.GC, cr.GPP, cr.GCA) == (3, 2, 2, 2, 1, 1, 50.0, 50.0)
    assert (old.LR, old.LA, old.RA, old.GC, old.GPP, old.GCA) == (3, 2, 1, 1, 95.0, 50.0)
    assert (demo.LR, demo.PC, demo.LA, demo.GPP, demo.GCA) == (1, 1, 0, 0.0, 0.0)
    assert (none.LR, none.LA, none.GPP, none.GCA) == (0, 0, 0.0, 0.0)


def test_all_apps_tiles(tables):
    assert one(reports.engagement_tiles(tables, "All", JANUARY)) == ("All", 6, 4, 2, 2, 72.5, 50.0)
    assert one(reports.engagement_tiles(tables, "CR", JANUARY)) == ("CR", 3, 2, 1, 1, 50.0, 50.0)
    assert rows(reports.funnel_steps_all_apps(tables, JANUARY), "pos", "step", "n") == [
        (1, "LR", 6), (2, "PC", 4), (3, "LA", 4), (4, "RA", 2), (5, "GC", 2)]


def test_unknown_progress_of_an_app_makes_the_mean_unknown(spark):
    df = spark.createDataFrame([(5, 1, 0, 0, None, 0.0), (5, 1, 0, 0, 10.0, 20.0)],
                               "LR long, LA long, RA long, GC long, GPP double, GCA double")
    assert one(funnel.all_apps_metrics(df)) == (10, 2, 0, 0, None, 10.0)


def test_global_metrics(spark):
    df = spark.createDataFrame([("a", 10, 4, 50.0), ("b", 30, 0, None)], "country string, LR long, LA long, GPP double")
    # the group of unknown GPP keeps its weight; columns that are not there count 0
    assert one(funnel.global_metrics(df)) == (40, 4, 0, 0, 12.5, 0.0)
    assert one(funnel.global_metrics(df.where("false"))) == (0, 0, 0, 0, 0.0, 0.0)


def test_combined_cohorts_and_keys(tables):
    users, reached = cohorts.combined_cohorts(tables, JANUARY)
    assert rows(users.groupBy("app").count()) == [("CR", 3), ("Unity", 3)]
    assert rows(reached.groupBy("app").count()) == [("CR", 3)]
    # legacy users have no learner id: they count in LA but not in LR, unless asked to
    plain = one(funnel.funnel_by_group(users, reached, "country", "All").where("country = 'Kenya'"), "LR", "LA", "GCA")
    both = one(funnel.funnel_by_group(users, reached, "country", "All", user_key="coalesce").where(
        "country = 'Kenya'"), "LR", "LA", "GCA")
    assert plain == (2, 3, 100.0)
    assert both == (5, 3, 66.67)


def test_map_reads_lr_from_launches(tables):
    assert rows(reports.report_map(tables, "CR", JANUARY, "LR")) == [("Ghana", 1, 100.0), ("Kenya", 2, 100.0)]
    assert rows(reports.report_map(tables, "CR", JANUARY, "LA"), "country", "LR", "LA") == [
        ("Ghana", 1, 1), ("Kenya", 2, 1)]
    assert rows(reports.report_map(tables, "Unity", JANUARY, "LR"), "country", "LR", "LA") == [("Kenya", 3, 2)]


def test_top_stats(tables):
    users, reached = cohorts.filtered_cohort(tables, "CR", JANUARY)
    assert [r.country for r in reports.top_stats(users, reached, "CR", "LA", percent=True).collect()] == [
        "Ghana", "Kenya"]
    assert rows(reports.top_stats(users, None, "CR", "LR", "app_language", n=None), "app_language", "LR") == [
        ("english", 1)]


def test_funnel_steps(progress):
    df = progress({"event": "download_completed"}, {"event": "tapped_start"},
                  {"event": "level_completed", "level": 3, "gpc": 10.0})
    large = rows(reports.funnel_steps(df, None, "CR", "large"), "pos", "step", "n", "percent_of_previous",
                 "percent_of_second")
    assert large[:4] == [(1, "LR", 3, None, None), (2, "DC", 3, 100.0, None), (3, "TS", 2, 66.7, 66.7),
                         (4, "SL", 1, 50.0, 33.3)]
    assert large[7] == (8, "GC", 0, None, 0.0)
    assert len(rows(reports.funnel_steps(df, None, "CR", "medium"))) == 7
    assert rows(reports.funnel_steps(df, None, "CR", "no such size"), "step")[0] == ("DC",)


def test_funnel_size():
    assert [reports.funnel_size(a) for a in ("Unity", ["x-Standalone"], ["All"], "CR", None)] == [
        "compact", "compact", "compact", "large", "large"]


def test_unknown_date_range_raises():
    for option in ("Select week", "Last few days", ""):
        with pytest.raises(ValueError):
            date_range(option, None, D(2024, 3, 10))
    assert date_range("Select month", (12, 2023), D(2024, 3, 10)) == (D(2023, 12, 1), D(2023, 12, 31))


def test_date_ranges():
    today = D(2024, 3, 10)
    assert date_range("All time", as_of=today) == (D(2021, 1, 1), today)
    assert date_range("Select year", 2023, today) == (D(2023, 1, 1), D(2023, 12, 31))
    assert date_range("Select year", 2024, today) == (D(2024, 1, 1), today)
    assert date_range("Select month", (2, 2024), today) == (D(2024, 2, 1), D(2024, 2, 29))
    assert date_range("Select month", (3, 2024), today, D(2024, 3, 5)) == (D(2024, 3, 1), D(2024, 3, 5))
    assert date_range("Last 7 days", as_of=today) == (D(2024, 3, 3), today)
    assert date_range("Select custom range", [D(2024, 1, 1), D(2030, 1, 1)], today) == (D(2024, 1, 1), D(2030, 1, 1))


def test_export_day_is_counted_in_los_angeles():
    assert export_day(dt.datetime(2024, 1, 10, 7, 0, tzinfo=dt.timezone.utc)) == D(2024, 1, 9)
    assert export_day(dt.datetime(2024, 1, 10, 9, 0, tzinfo=dt.timezone.utc)) == D(2024, 1, 10)
