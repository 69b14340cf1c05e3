"""App launches: first launch per learner, device, country, language and first-open day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.config import AppProfile
from readtrail.functions.dates import in_reporting_window, micros_to_date, micros_to_timestamp
from readtrail.functions.params import param_str, url_param

LAUNCH = ["cr_user_id", "user_pseudo_id", "country", "app_language", "first_open"]


def is_launch_event(profile: AppProfile) -> Column:
    return (F.col("event_name") == "app_launch") & (F.col("app_info.id") == profile.container_app_id)


def launched_url() -> Column:
    return param_str("web_app_url")


def is_known_launch(profile: AppProfile, as_of: dt.date | None = None) -> Column:
    """Of flat launches: a URL of the web game, a user id (may be empty, not NULL), a first touch in the window."""
    return (
        F.col("url").startswith(f"https://{profile.web_host}")
        & F.col("cr_user_id").isNotNull()
        & in_reporting_window(F.col("first_open"), as_of)
    )


def with_language(launches: DataFrame) -> DataFrame:
    language = url_param(F.col("url"), config.URL_LANGUAGE_PARAM)
    return launches.withColumn("app_language", language).select(*LAUNCH, "event_timestamp")


def filter_launches(raw: DataFrame, profile: AppProfile, as_of: dt.date | None = None) -> DataFrame:
    """Launches of the web game from the container app.

    The user id may be an empty text here, but not NULL; a launch without a first
    touch is dropped.
    """
    flat = raw.where(is_launch_event(profile)).select(
        param_str("cr_user_id").alias("cr_user_id"),
        "user_pseudo_id",
        F.col("geo.country").alias("country"),
        launched_url().alias("url"),
        micros_to_date(F.col("user_first_touch_timestamp")).alias("first_open"),
        "event_timestamp",
    )
    return with_language(flat.where(is_known_launch(profile, as_of)))


def first_launches(launches: DataFrame) -> DataFrame:
    return (
        launches.groupBy(*LAUNCH)
        .agg(F.min("event_timestamp").alias("first_us"))
        .select(*LAUNCH, micros_to_timestamp(F.col("first_us")).alias("first_launch_ts"))
    )


def join_cohorts(launches: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Add cohort_name; a learner in several cohorts gets a row for each."""
    return launches.join(cohorts.select("cr_user_id", "cohort_name"), "cr_user_id", "left")


def launch_table(launches: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Launch table, as it is exported, from filtered launches."""
    table = join_cohorts(first_launches(launches), cohorts)
    return table.select(*LAUNCH[:4], "first_open", "first_launch_ts", "cohort_name")


def app_launch(
    raw: DataFrame, cohorts: DataFrame, profile: AppProfile, as_of: dt.date | None = None
) -> DataFrame:
    """Launch table, grain (user, device, country, language, first-open day, cohort)."""
    return launch_table(filter_launches(raw, profile, as_of), cohorts)


def active_countries(unity: DataFrame, cr: DataFrame) -> DataFrame:
    """Countries of both progress tables, each once; a NULL country stays as one row."""
    # each side is reduced to its countries before the union
    return unity.select("country").distinct().union(cr.select("country").distinct()).distinct()
