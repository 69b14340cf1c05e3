"""Game events and their roll-up to one row per (learner, country, language)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.config import AppProfile
from readtrail.functions import numbers as N
from readtrail.functions.dates import in_reporting_window, micros_to_date, parse_day
from readtrail.functions.params import (
    event_of_stage,
    funnel_stage,
    is_standalone_host,
    label_app,
    param_int,
    param_str,
    url_param,
)
from readtrail.operators.activity import session_stats_cr
from readtrail.sources.snapshots import stage

LEARNER = ["cr_user_id", "country", "app_language"]


def game_events(raw: DataFrame, *more: Column) -> DataFrame:
    """Flatten the event log to the columns the learner roll-up uses."""
    page = param_str("page_location")
    return raw.select(
        "user_pseudo_id",
        param_str("cr_user_id").alias("cr_user_id"),
        micros_to_date(F.col("user_first_touch_timestamp")).alias("first_open"),
        F.col("geo.country").alias("country"),
        page.alias("page_location"),
        url_param(page, config.URL_LANGUAGE_PARAM).alias("app_language"),
        # the game counts levels from 0; everything downstream counts from 1
        (param_int("level_number") + 1).alias("level_number"),
        param_int("number_of_successful_puzzles").alias("number_of_successful_puzzles"),
        param_str("success_or_failure").alias("success_or_failure"),
        "event_name",
        funnel_stage(F.col("event_name")).alias("funnel_stage"),
        parse_day(F.col("event_date")).alias("event_dt"),
        F.col("device.web_info.hostname").alias("hostname"),
        "event_timestamp",
        *more,
    )


def is_game_event() -> Column:
    """Funnel events; the event name is a plain column of the log, so this reaches the scan."""
    return F.col("event_name").isin(list(config.STAGE_NUMBERS))


def is_known_game_event(profile: AppProfile, as_of: dt.date | None = None) -> Column:
    """Of :func:`game_events`: known host, a user id, first seen in the reporting window."""
    host = F.col("hostname")
    web = host.startswith(profile.web_host) & F.col("page_location").contains(
        f"https://{profile.web_host}"
    )
    known_host = web | is_standalone_host(host, profile) | (host == profile.bundled_host)
    first_seen = F.coalesce(F.col("first_open"), F.col("event_dt"))
    return known_host & (F.col("cr_user_id") != "") & in_reporting_window(first_seen, as_of)


def filter_cr_events(raw: DataFrame, profile: AppProfile, as_of: dt.date | None = None) -> DataFrame:
    """Funnel events of known hosts, with a user id, first seen in the reporting window."""
    events = game_events(raw.where(is_game_event()))
    return events.where(is_known_game_event(profile, as_of)).drop("page_location")


def join_max_level(events: DataFrame, languages: DataFrame) -> DataFrame:
    """Add max_game_level by language; a language listed twice doubles its events."""
    levels = languages.select("app_language", F.col("max_level").alias("max_game_level"))
    return events.join(levels, "app_language", "left")


def qualifying_level() -> Column:
    """A finished level that counts: enough puzzles solved and a known level number."""
    return (
        (F.col("event_name") == "level_completed")
        & (F.col("number_of_successful_puzzles") >= config.MIN_PUZZLES)
        & F.col("level_number").isNotNull()
    )


def _milestone_aggregates() -> dict[str, Column]:
    done, level, day = qualifying_level(), F.col("level_number"), F.col("event_dt")
    return {
        "la_date": F.min(F.when(done, day)),
        "ra_exact": F.min(F.when(done & (level == config.READER_LEVEL), day)),
        "ra_later": F.min(F.when(done & (level > config.READER_LEVEL), day)),
        "max_user_level": F.max(F.when(done, level).otherwise(F.lit(0))),
    }


def _aliased(aggregates: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in aggregates.items()]


def _ra_date() -> Column:
    # no completion of the reader level itself: the first one beyond it counts
    return F.coalesce("ra_exact", "ra_later")


def milestone_dates(events: DataFrame, keys: list[str] = LEARNER) -> DataFrame:
    """First qualifying level (la_date), reader level (ra_date) and highest level."""
    return (
        events.groupBy(*keys)
        .agg(*_aliased(_milestone_aggregates()))
        .select(*keys, "la_date", _ra_date().alias("ra_date"), "max_user_level")
    )


def event_counts(events: DataFrame, keys: list[str] = LEARNER) -> DataFrame:
    """Qualifying levels and events of each kind per learner."""
    kinds = ["puzzle_completed", "selected_level", "tapped_start", "download_completed"]
    return events.groupBy(*keys).agg(
        F.count_if(qualifying_level()).alias("level_completed_count"),
        *[F.count_if(F.col("event_name") == kind).alias(f"{kind}_count") for kind in kinds],
    )


def furthest_event(events: DataFrame, keys: list[str] = LEARNER) -> DataFrame:
    """Furthest funnel stage reached and the event of that stage."""
    return (
        events.groupBy(*keys)
        .agg(F.max("funnel_stage").alias("furthest_stage"))
        .withColumn("furthest_event", event_of_stage(F.col("furthest_stage")))
    )


def first_by_order(
    events: DataFrame, keys: list[str], values: list[str], day: str = "event_dt",
    ts: str = "event_timestamp",
) -> DataFrame:
    """Values of the earliest event of each group.

    Grouped by the values as well first: few distinct ones remain, and that aggregate
    keeps only numbers per group.  Order is the earliest day with these values, then the
    earliest time with them, then the values.
    """
    distinct = events.groupBy(*keys, *values).agg(
        F.min(day).alias("_day"), F.min(ts).alias("_ts")
    )
    return distinct.groupBy(*keys).agg(
        F.min(F.struct("_day", "_ts", *values)).alias("_first")
    ).select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def last_event(events: DataFrame, key: str = "cr_user_id") -> DataFrame:
    """Last event day per user, over all countries and languages."""
    return events.groupBy(key).agg(F.max("event_dt").alias("last_event_date"))


_IDENTITY = ["user_pseudo_id", "hostname"]
DEVICE = [*LEARNER, *_IDENTITY]
# how the numbers of a (learner, device, host) row go together with those of another
DEVICE_MERGE = {
    "first_open": F.min, "first_event_date": F.min, "first_us": F.min, "furthest_stage": F.max,
    "la_date": F.min, "ra_exact": F.min, "ra_later": F.min, "max_user_level": F.max,
}


def device_rollup(events: DataFrame) -> DataFrame:
    """Numbers and dates per (learner, device, host): a hash aggregate over the full log.

    Rows of different parts of a log merge by ``DEVICE_MERGE``.
    """
    return events.groupBy(*DEVICE).agg(
        F.min("first_open").alias("first_open"),
        F.min("event_dt").alias("first_event_date"),
        F.min("event_timestamp").alias("first_us"),
        F.max("funnel_stage").alias("furthest_stage"),
        *_aliased(_milestone_aggregates()),
    )


def learners_of_devices(per_device: DataFrame) -> DataFrame:
    """Fold the one or two rows left per learner, and pick device and host of the earliest."""
    return (
        per_device.groupBy(*LEARNER)
        .agg(
            F.min(F.struct("first_event_date", "first_us", *_IDENTITY)).alias("earliest"),
            *[fold(c).alias(c) for c, fold in DEVICE_MERGE.items() if c not in ("first_event_date", "first_us")],
        )
        .select(
            *LEARNER,
            "earliest.*",
            "first_open",
            "furthest_stage",
            event_of_stage(F.col("furthest_stage")).alias("furthest_event"),
            "la_date",
            _ra_date().alias("ra_date"),
            "max_user_level",
        )
        .drop("first_us")
    )


def learner_rollup(events: DataFrame) -> DataFrame:
    """Aggregate game events per (learner, country, language).

    Two steps.  The first also groups by device and host, so it keeps nothing but
    numbers and dates; the second folds the few rows left per learner.
    """
    return learners_of_devices(device_rollup(events))


def milestone_flags(df: DataFrame) -> DataFrame:
    """pc/la/ra/gc/lr flags from furthest_stage, max_user_level and gpc."""
    level, gpc = F.col("max_user_level"), F.col("gpc")
    return df.withColumns({
        "pc_flag": N.flag(F.col("furthest_stage") >= config.STAGE_NUMBERS["puzzle_completed"]),
        "la_flag": N.flag(N.is_learner_acquired(level)),
        "ra_flag": N.flag(N.is_reader_acquired(level)),
        "gc_flag": N.flag(N.is_game_completed(level, gpc)),
        "lr_flag": F.lit(1),
    })


def days_to_ra(ra_date: Column, first_open: Column, first_event: Column) -> Column:
    """Days from the earlier first date to the reader milestone, counting from 1."""
    return F.date_diff(ra_date, N.least_known(first_open, first_event)) + 1


def active_span(last_event_date: Column, first_open: Column, first_event: Column) -> Column:
    """Days from the earlier first date to the last event; cleaning clips it at 0."""
    return F.date_diff(last_event_date, N.least_known(first_open, first_event))


def cr_user_progress(events: DataFrame, languages: DataFrame) -> DataFrame:
    """Learner progress table from :func:`filter_cr_events` output.

    Grain is (cr_user_id, country, app_language).  Session figures and the last
    event day are per user, so they repeat on each of a user's rows.
    """
    return with_user_stats(learner_rollup(events), session_stats_cr(events, last_day="event_dt"), languages)


def with_user_stats(learners: DataFrame, per_user: DataFrame, languages: DataFrame) -> DataFrame:
    """Learner rows with game length, the figures of their user, and flags."""
    game_length = languages.groupBy("app_language").agg(F.max("max_level").alias("max_game_level"))
    first_open, first_event = F.col("first_open"), F.col("first_event_date")
    table = (
        learners.join(game_length, "app_language", "left")
        .join(per_user, "cr_user_id", "left")
        .withColumn("gpc", N.game_progress(F.col("max_user_level"), F.col("max_game_level")))
    )
    return milestone_flags(table).withColumns({
        "days_to_ra": days_to_ra(F.col("ra_date"), first_open, first_event),
        "active_span": active_span(F.col("last_event_date"), first_open, first_event),
    })


CR_COLUMNS = [
    "user_pseudo_id", "cr_user_id", "first_open", "first_event_date", "country",
    "app_language", "app", "max_user_level", "max_game_level", "la_date", "ra_date",
    "days_to_ra", "furthest_event", "gpc", "session_count", "engagement_event_count",
    "total_time_minutes", "avg_session_length_minutes", "last_event_date", "active_span",
    "pc_flag", "la_flag", "ra_flag", "gc_flag", "lr_flag",
]


def build_cr_user_progress(
    raw: DataFrame, languages: DataFrame, profile: AppProfile, as_of: dt.date | None = None,
    staging: str | None = None,
) -> DataFrame:
    """Progress table from the raw log.

    Roll-up and sessions both read the filtered events; see :func:`stage` for what
    ``staging`` does about that.
    """
    events = filter_cr_events(raw, profile, as_of).drop("success_or_failure")
    return progress_table(stage(events, staging), languages, profile)


def progress_table(events: DataFrame, languages: DataFrame, profile: AppProfile) -> DataFrame:
    """Progress table, as it is exported, from filtered events."""
    return exported(cr_user_progress(events, languages), profile)


def exported(table: DataFrame, profile: AppProfile) -> DataFrame:
    return table.withColumn("app", label_app(F.col("hostname"), profile)).select(*CR_COLUMNS)
