"""Merged aggregates against the reports that fold the learner tables."""

import datetime as dt
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readtrail.operators import bitmaps, funnel
from readtrail.operators.cohorts import CohortFilter, LearnerTables, combined_cohorts, filtered_cohort
from readtrail.plans import reports
from readtrail.plans.cube import report_cube
from readtrail.sources.snapshots import stage

D = dt.date
USERS = ("cr_user_id string, user_pseudo_id string, first_open date, country string, app_language string, app string, "
         "furthest_event string, max_user_level bigint, gpc double")


def tables(spark, seed=1, n=400):
    """Learners may have several rows, several countries, no id; groups may be NULL."""
    r = random.Random(seed)
    events = ["session_start", "download_completed", "tapped_start", "selected_level", "puzzle_completed", "level_completed"]
    day = lambda: r.choice([None, D(2024, 1, 1) + dt.timedelta(days=r.randrange(30))])
    country = lambda: r.choice(["Kenya", "Ghana", "Mali", None])
    language = lambda: r.choice(["english", "french", None])

    def row(app):
        user = r.choice([None, *[f"u{k}" for k in range(150)]])
        level = r.choice([0, 0, 3, 25, 30])
        return (user, f"d-{user}", day(), country(), language(), app, r.choice(events), level, r.choice([None, 5.0, 95.0]))

    progress = spark.createDataFrame([row(r.choice(["CR", "CR", "WBS-standalone"])) for _ in range(n)], USERS)
    legacy = spark.createDataFrame([row("Unity") for _ in range(n // 2)], USERS).drop("cr_user_id")
    launches = spark.createDataFrame([row(None) for _ in range(n)], USERS).select(
        "cr_user_id", "user_pseudo_id", "first_open", "country", "app_language")
    return LearnerTables(progress, legacy, launches)


@pytest.fixture(scope="module")
def learner_tables(spark, tmp_path_factory):
    t, base = tables(spark), str(tmp_path_factory.mktemp("tables"))
    return LearnerTables(*[stage(getattr(t, n), f"{base}/{n}") for n in ("progress", "legacy", "launches")])


FILTERS = [
    CohortFilter(), CohortFilter((D(2024, 1, 5), D(2024, 1, 9)), ["english", None], None),
    CohortFilter((D(2024, 1, 1), D(2024, 1, 30)), None, ["Kenya", "Mali"]), CohortFilter((D(2030, 1, 1), D(2030, 1, 2))),
]


def close(df):
    return rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]))


def test_codes_are_dense_and_stay(spark, tmp_path, learner_tables):
    learners = learner_tables.progress
    first = stage(bitmaps.learner_codes(learners.where("country = 'Kenya'"), "cr_user_id", str(tmp_path / "a")), str(tmp_path / "c1"))
    n = learners.where("country = 'Kenya'").select("cr_user_id").where("cr_user_id IS NOT NULL").distinct().count()
    assert sorted(r.code for r in first.collect()) == list(range(n))
    both = bitmaps.learner_codes(learners, "cr_user_id", str(tmp_path / "b"), first)
    got = {r.cr_user_id: r.code for r in both.collect()}
    assert sorted(got.values()) == list(range(learners.select("cr_user_id").where("cr_user_id IS NOT NULL").distinct().count()))
    assert all(got[r.cr_user_id] == r.code for r in first.collect())


@pytest.mark.parametrize("by", ["country", "app_language"])
def test_any_cohort_is_a_merge_of_daily_sets(spark, tmp_path, learner_tables, by):
    t = learner_tables
    columns = ["cr_user_id", "first_open", "country", "app_language"]
    everyone = t.progress.select(columns).unionByName(t.launches.select(columns))
    codes = stage(bitmaps.learner_codes(everyone, "cr_user_id", str(tmp_path / "o")), str(tmp_path / "c"))
    sets = bitmaps.funnel_bitmaps(t.progress, t.launches, codes.withColumn("code", F.col("code") * 1000))  # over many buckets
    for filters in FILTERS:
        users, launches = filtered_cohort(t, "CR", filters)
        want = funnel.funnel_by_group(users, launches, by, "CR")
        assert close(bitmaps.funnel_of_bitmaps(sets, filters, by)) == close(want)


@pytest.mark.parametrize("app", ["CR", "Unity", "All", "WBS-standalone"])
def test_reports_of_a_cube(learner_tables, app):
    t = learner_tables
    for filters in FILTERS:
        cube = report_cube(t, app, filters)
        users, reached = combined_cohorts(t, filters) if app == "All" else filtered_cohort(t, [app], filters)
        for by in ("country", "app_language"):
            assert close(cube.funnel(by)) == close(funnel.funnel_by_group(users, reached, by, app))
            assert close(cube.funnel(by, True)) == close(funnel.funnel_by_group(users, reached, by, app, True))
            want = reports.report_top(t, app, filters, "RA", by, percent=True, n=None)
            assert [r[by] for r in cube.top("RA", by, True, None).collect()] == [r[by] for r in want.collect()]
        assert close(cube.map("LA")) == close(reports.report_map(t, app, filters, "LA"))
        assert close(cube.steps("large")) == close(reports.funnel_steps(users, reached, app, "large"))
        assert rows(cube.tiles()) == rows(reports.single_app_tiles(t, app, filters))
        assert close(cube.map("LR")) == close(reports.report_map(t, app, filters, "LR"))


def test_a_cube_scans_each_table_once(learner_tables, tmp_path):
    cube = report_cube(learner_tables, "CR", FILTERS[1], None)
    plan = cube.frame._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet[^\n]*Location: [^\n]*?/(progress|launches|legacy)\]", plan)
    assert sorted(scans) == ["launches", "progress"]
    staged = report_cube(learner_tables, "CR", FILTERS[1], str(tmp_path / "cube"))
    plan = staged.map("LA")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
