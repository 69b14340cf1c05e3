"""Legacy-app events and their roll-up to one row per user."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.config import AppProfile
from readtrail.functions import numbers as N
from readtrail.functions.dates import in_reporting_window, micros_to_date, parse_day
from readtrail.functions.params import app_suffix, level_from_action
from readtrail.operators.activity import session_stats_unity
from readtrail.sources.snapshots import stage

_PLAIN_EVENTS = ["session_start", "user_engagement"]
_PLAY_EVENT = "GamePlay"


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """UNION ALL of event logs with the same columns."""
    return reduce(DataFrame.unionByName, sources)


def explode_params(events: DataFrame) -> DataFrame:
    """One row per event parameter; events without parameters disappear."""
    return events.withColumn("param", F.explode("event_params")).drop("event_params").select(
        "*",
        F.col("param.key").alias("param_key"),
        F.col("param.value.string_value").alias("param_text"),
    ).drop("param")


def filter_unity_events(
    raw: DataFrame, profile: AppProfile, as_of: dt.date | None = None, dedupe_events: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """Level and segment successes, session starts and engagement of the legacy apps.

    A session start counts once per parameter it carries.  ``dedupe_events=True``
    keeps each such event once, and keeps those without any parameter.  A level that is no
    number ends the job, or is NULL with ``lenient``.
    """
    first_open = micros_to_date(F.col("user_first_touch_timestamp"))
    plain = F.col("event_name").isin(_PLAIN_EVENTS)
    # whatever does not depend on the parameter is tested before the explode
    candidates = raw.where(
        F.col("event_name").isin([_PLAY_EVENT, *_PLAIN_EVENTS])
        & F.lower("app_info.id").contains(profile.legacy_marker.lower())
        & in_reporting_window(first_open, as_of)
    )
    if dedupe_events:
        # one stand-in parameter, so the explode yields each plain event exactly once
        blank = F.array(F.lit(None).cast(raw.schema["event_params"].dataType.elementType))
        candidates = candidates.withColumn(
            "event_params", F.when(plain, blank).otherwise(F.col("event_params"))
        )
    text = F.col("param_text")
    play = (
        (F.col("event_name") == _PLAY_EVENT)
        & (F.col("param_key") == "action")
        & (text.startswith("LevelSuccess") | text.startswith("SegmentSuccess"))
    )
    rows = explode_params(candidates).where(plain | play)
    level_done = play & text.startswith("LevelSuccess")
    day = parse_day(F.col("event_date"))
    return rows.select(
        "user_pseudo_id",
        "event_name",
        micros_to_date(F.col("user_first_touch_timestamp")).alias("first_open"),
        F.col("geo.country").alias("country"),
        app_suffix(F.col("app_info.id"), profile.legacy_marker).alias("app_language"),
        F.col("app_info.version").alias("app_version"),
        day.alias("event_dt"),
        "event_timestamp",
        F.when(level_done, day).alias("level_success_date"),
        F.when(level_done, level_from_action(text, lenient)).alias("user_level"),
        F.when(text == F.lit(f"LevelSuccess_{config.READER_LEVEL}"), F.when(play, day)).alias(
            "reader_date"
        ),
        N.flag(level_done).alias("level_completed_flag"),
        N.flag(play & text.startswith("SegmentSuccess")).alias("puzzle_completed_flag"),
        N.flag(F.col("event_name") == "session_start").alias("session_start_flag"),
    )


def join_dedup_dim(events: DataFrame, languages: DataFrame) -> DataFrame:
    """Add max_game_level by language; equal (language, level) rows count once."""
    levels = languages.select(
        "app_language", F.col("max_level").alias("max_game_level")
    ).dropDuplicates()
    return events.join(levels, "app_language", "left")


def level_skips(events: DataFrame, key: str = "user_pseudo_id", level: str = "user_level") -> DataFrame:
    """Per user with any level: highest level, and whether a level below it is missing.

    Counting the distinct levels from 1 up says whether all of 1..max were played,
    without building either list.
    """
    distinct = events.where(F.col(level).isNotNull()).select(key, level).distinct()
    return distinct.groupBy(key).agg(
        F.max(level).alias("max_played_level"),
        (F.count_if(F.col(level) >= 1) < F.max(level)).alias("skipped_level"),
    )


def _furthest_event(levels: Column, puzzles: Column, starts: Column) -> Column:
    return (
        F.when(levels > 0, "level_completed")
        .when(puzzles > 0, "puzzle_completed")
        .when(starts > 0, "session_start")
    )


_FLAGS = ["level_completed_flag", "puzzle_completed_flag", "session_start_flag"]
_FIRSTS = ["first_open", "level_success_date", "reader_date", "first_event_date"]
_TEXTS = ["country", "app_language", "app_version"]


def _fold_numbers() -> list[Column]:
    return (
        [F.min(c).alias(c) for c in _FIRSTS]
        + [F.sum(c).alias(c) for c in _FLAGS]
        + [F.max("last_event_date").alias("last_event_date")]
    )


def _fold_texts() -> list[Column]:
    return [F.max(c).alias(c) for c in [*_TEXTS, "max_game_level"]]


LEVEL_TEXTS = ["user_pseudo_id", "user_level", *_TEXTS]


def level_rollup(events: DataFrame) -> DataFrame:
    """Numbers and dates per (user, level and text columns): the one pass over the full log."""
    return merge_levels(events.withColumns({
        "first_event_date": F.col("event_dt"), "last_event_date": F.col("event_dt"),
    }))


def merge_levels(rows: DataFrame) -> DataFrame:
    """Fold rows of one (user, level and text columns), as from different parts of a log."""
    return rows.groupBy(*LEVEL_TEXTS).agg(*_fold_numbers())


def unity_user_progress(events: DataFrame, languages: DataFrame) -> DataFrame:
    """Legacy progress table, one row per user, from :func:`filter_unity_events`."""
    return users_of_levels(level_rollup(events), session_stats_unity(events), languages)


def users_of_levels(by_text: DataFrame, stats: DataFrame, languages: DataFrame) -> DataFrame:
    """Legacy progress from :func:`level_rollup` and the users' session figures.

    Two more steps, each smaller than the one before: per (user, level), which gives the
    distinct levels, and per user.
    """
    key = "user_pseudo_id"
    by_level = join_dedup_dim(by_text, languages).groupBy(key, "user_level").agg(
        *_fold_numbers(), *_fold_texts()
    )
    level = F.col("user_level")
    users = by_level.groupBy(key).agg(
        *_fold_numbers(),
        *_fold_texts(),
        F.coalesce(F.max(level), F.lit(0)).alias("max_user_level"),
        F.coalesce(F.count_if(level >= 1) < F.max(level), F.lit(False)).alias("has_gap"),
    ).withColumn(
        "gpc", N.game_progress(F.col("max_user_level"), F.col("max_game_level"))
    )
    top, gpc = F.col("max_user_level"), F.col("gpc")
    return users.join(stats, key, "left").select(
        key,
        "first_open",
        "country",
        "app_language",
        "max_user_level",
        "max_game_level",
        "app_version",
        F.col("level_success_date").alias("la_date"),
        F.lit(None).cast("bigint").alias("started_in_offline_mode"),
        F.lit("Unity").alias("app"),
        F.col("reader_date").alias("ra_date"),
        F.date_diff("reader_date", "first_open").alias("days_to_ra"),
        "first_event_date",
        "last_event_date",
        N.clip_low(F.date_diff("last_event_date", "first_event_date"), 1).alias("active_span"),
        "engagement_event_count",
        "total_time_minutes",
        "avg_session_length_minutes",
        F.col("level_completed_flag").alias("level_completed_count"),
        F.col("session_start_flag").alias("total_sessions"),
        _furthest_event(*[F.col(c) for c in _FLAGS]).alias("furthest_event"),
        "gpc",
        N.flag(N.is_learner_acquired(top)).alias("la_flag"),
        N.flag(N.is_reader_acquired(top)).alias("ra_flag"),
        N.flag(N.is_game_completed(top, gpc)).alias("gc_flag"),
        F.lit(1).alias("lr_flag"),
        # rows without a user id match no level check
        (F.col("has_gap") & F.col(key).isNotNull()).alias("skipped_level"),
    )


def build_unity_user_progress(
    raw: DataFrame, languages: DataFrame, profile: AppProfile, as_of: dt.date | None = None,
    staging: str | None = None, dedupe_events: bool = False, lenient: bool = False,
) -> DataFrame:
    """Legacy progress table from the raw log; ``staging`` as in :func:`stage`."""
    events = filter_unity_events(raw, profile, as_of, dedupe_events, lenient).drop("event_name")
    return unity_user_progress(stage(events, staging), languages)
