"""Nightly build from the new days of the log and what earlier nights left behind.

A full build reads the whole history every night.  Here a night reads its new events once
and folds them into states that go together in any order:

- learners: the numbers per (learner, device, host), or per (user, level) of the legacy apps;
- activity: the slices that the night's events fall into, kept per night and split by day;
- days: what each day of a user adds to the user's sessions, two open edges and totals.

Only days that new events fall into are worked out anew, from the slices of all nights that
touched them, so events may come late by any time and the result is that of a full build.
Each state is a published run: a night that dies leaves the states of the night before, and
doing a night again replaces it.  A night does not see runs of its own day or later.

One thing differs from a full build on a later day: events of users first seen after a
night's ``as_of`` (a clock that runs ahead) are left out for good.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrail import config
from readtrail.config import AppProfile
from readtrail.operators import activity
from readtrail.operators.learners import (
    DEVICE,
    DEVICE_MERGE,
    device_rollup,
    exported,
    learners_of_devices,
    with_user_stats,
)
from readtrail.operators.legacy import level_rollup, merge_levels, users_of_levels
from readtrail.sources.snapshots import Run, export_run, newest_run, published_runs


def _earlier(spark: SparkSession, base: str, run_date: dt.date) -> Run | None:
    try:
        return newest_run(spark, base, run_date)
    except FileNotFoundError:
        return None


def _published(
    df: DataFrame, base: str, run_date: dt.date, metrics: dict[str, Column] | None = None, split_by: str | None = None
) -> DataFrame:
    path = export_run(df, base, run_date, metrics, split_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _merged_state(
    new: DataFrame, merge: Callable[[DataFrame], DataFrame], base: str, run_date: dt.date
) -> DataFrame:
    """Publish the state of the night before together with the new rows; gives it read back."""
    spark = new.sparkSession
    before = _earlier(spark, base, run_date)
    rows = new if before is None else before.read(spark).unionByName(new)
    return _published(merge(rows), base, run_date)


def merge_devices(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DEVICE).agg(*[fold(c).alias(c) for c, fold in DEVICE_MERGE.items()])


def _touching(spark: SparkSession, base: str, run_date: dt.date, days: list[int]) -> list[Run]:
    """Runs of slices, up to a night, that may hold one of the days."""
    return [
        run for run in published_runs(spark, base)
        if run.day <= run_date and run.rows and run.metrics["first_day"] <= days[-1] and run.metrics["last_day"] >= days[0]
    ]


def advance_sessions(
    events: DataFrame, key: str, base: str, run_date: dt.date, gap: int = config.SESSION_GAP_SECONDS,
    last_day: str | None = None, ts: str = "event_timestamp",
) -> DataFrame:
    """Session figures per user of all events so far, given the new ones of a night."""
    spark = events.sparkSession
    extra = [F.max(last_day).alias(last_day)] if last_day else []
    slices = activity.activity_slices(events, key, ts, gap, extra).withColumn("day_no", activity.slice_day())
    bounds: dict[str, Column] = {"first_day": F.min("day_no"), "last_day": F.max("day_no")}
    new = _published(slices, f"{base}/slices", run_date, bounds, split_by="day_no")
    before = _earlier(spark, f"{base}/days", run_date)
    # as many as days of history at most
    touched = sorted(r.day_no for r in new.select("day_no").distinct().collect())
    parts = [new.where("false").drop("day_no")]
    if touched:
        parts += [
            run.read(spark).where(F.col("day_no").isin(touched)).drop("day_no")
            for run in _touching(spark, f"{base}/slices", run_date, touched)
        ]
    slices_of_days = activity.merge_slices(reduce(DataFrame.unionByName, parts), key, last_day)
    days = activity.day_sessions(slices_of_days, key, gap, last_day)
    if before is not None:
        days = days.unionByName(before.read(spark).where(~F.col("day_no").isin(touched)))
    return activity.stats_of_days(_published(days, f"{base}/days", run_date), key, gap, last_day)


def advance_progress(
    events: DataFrame, languages: DataFrame, profile: AppProfile, base: str, run_date: dt.date
) -> DataFrame:
    """Learner progress of all events so far, from the new (filtered) game events of a night."""
    devices = _merged_state(device_rollup(events), merge_devices, f"{base}/devices", run_date)
    stats = advance_sessions(events, "cr_user_id", f"{base}/activity", run_date, last_day="event_dt")
    return exported(with_user_stats(learners_of_devices(devices), stats, languages), profile)


def advance_legacy(events: DataFrame, languages: DataFrame, base: str, run_date: dt.date) -> DataFrame:
    """Legacy progress of all events so far, from the new (filtered) events of a night."""
    levels = _merged_state(level_rollup(events), merge_levels, f"{base}/levels", run_date)
    stats = advance_sessions(events, "user_pseudo_id", f"{base}/activity", run_date)
    return users_of_levels(levels, activity.legacy_figures(stats), languages)
