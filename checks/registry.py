"""Registered queries: every operator run over the driver's whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as A
from readtrail import config
from readtrail.functions import numbers as N
from readtrail.functions.dates import date_range, fix_dates, micros_to_date
from readtrail.functions.params import (
    app_suffix,
    event_of_stage,
    funnel_stage,
    label_app,
    level_from_action,
    param_int,
    param_str,
    url_param,
)
from readtrail.operators import activity, bitmaps, campaigns, cleaning, cohorts, funnel, launches
from readtrail.operators import learners, legacy, matching
from readtrail.operators.cohorts import CohortFilter
from readtrail.plans import cube, incremental, reports
from readtrail.sources import lists, spend
from readtrail.sources.events import scan_events
from readtrail.sources.snapshots import export_csv, export_run, load_latest_run, save_table, stage
from readtrail.session import scratch_folder
from readtrail.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

FILTER = CohortFilter(A.COHORT_RANGE, A.COHORT_LANGUAGES, None)
WIDE_GAP = 3600


def query(fn: Query) -> Query:
    _queries[fn.__name__.rstrip("_")] = fn
    return fn


def _utc(ts: str) -> Column:
    """Timestamp as UTC wall-clock time, whatever the session time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(ts).cast("timestamp_ntz")).alias(ts)


def _plain_launches(df: DataFrame) -> DataFrame:
    return df.withColumn("first_launch_ts", _utc("first_launch_ts"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Means of floats depend on the order of addition in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.filter_cr_events(A.game_log(spark, sf_dir), A.PROFILE, A.AS_OF)


def _legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.filter_unity_events(A.legacy_log(spark, sf_dir), A.PROFILE, A.AS_OF)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare event stream: event_id, user_id, event_timestamp."""
    return A.plain_events(spark, sf_dir).select(
        "event_id", "user_id", F.col("us").alias("event_timestamp")
    )


# --- sources ---------------------------------------------------------------------


@query
def event_scan(spark, sf_dir):
    log = scan_events(A.game_log(spark, sf_dir), A.COHORT_RANGE[0], A.COHORT_RANGE[1])
    return log.groupBy("event_date", "event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_timestamp").alias("first_us"),
        F.max("event_timestamp").alias("last_us"),
    )


@query
def union_sources(spark, sf_dir):
    log = legacy.union_sources(A.legacy_sources(spark, sf_dir))
    return log.groupBy("user_pseudo_id", "event_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_timestamp").alias("last_us")
    )


@query
def latest_run_scan(spark, sf_dir):
    base = scratch_folder(spark, "last-events")
    table = learners.last_event(_events(spark, sf_dir))
    export_run(table.withColumn("run", F.lit("older")), base, A.COHORT_RANGE[0])
    export_run(table.withColumn("run", F.lit("newest")), base, A.RUN_DATE)
    return load_latest_run(spark, base)


@query
def language_list(spark, sf_dir):
    return lists.language_list(A.display_languages(spark, sf_dir))


@query
def country_list(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return lists.country_list(launches.active_countries(raw.legacy, raw.progress))


@query
def app_versions(spark, sf_dir):
    return lists.app_version_list(A.app_versions(spark, sf_dir))


@query
def google_spend(spark, sf_dir):
    return spend.google_spend(A.google_stats(spark, sf_dir), A.google_campaigns(spark, sf_dir))


@query
def facebook_spend(spark, sf_dir):
    return spend.facebook_spend(A.facebook_ads(spark, sf_dir))


# --- projections and filters -------------------------------------------------------


@query
def event_params(spark, sf_dir):
    return A.game_log(spark, sf_dir).select(
        "event_timestamp",
        param_str("cr_user_id").alias("cr_user_id"),
        param_str("page_location").alias("page_location"),
        param_int("level_number").alias("level_number"),
        param_int("number_of_successful_puzzles").alias("puzzles"),
        param_str("success_or_failure").alias("success_or_failure"),
        param_str("no_such_key").alias("absent"),
    )


@query
def cr_event_filter(spark, sf_dir):
    return _events(spark, sf_dir)


@query
def launch_filter(spark, sf_dir):
    return launches.filter_launches(A.launch_log(spark, sf_dir), A.PROFILE, A.AS_OF)


@query
def unity_event_filter(spark, sf_dir):
    return _legacy_events(spark, sf_dir)


@query
def app_label(spark, sf_dir):
    host = F.col("device.web_info.hostname")
    return A.game_log(spark, sf_dir).select("event_timestamp", label_app(host, A.PROFILE).alias("app"))


@query
def url_language(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", url_param(F.col("url"), "page").alias("page"))


@query
def suffix_language(spark, sf_dir):
    app = F.col("app_info.id")
    return A.legacy_log(spark, sf_dir).select(
        "event_timestamp", app_suffix(app, A.PROFILE.legacy_marker).alias("app_language")
    )


@query
def action_level(spark, sf_dir):
    rows = legacy.explode_params(A.legacy_log(spark, sf_dir))
    levels = rows.where(F.col("param_text").startswith("LevelSuccess"))
    return levels.select("event_timestamp", level_from_action(F.col("param_text")).alias("user_level"))


@query
def funnel_stage_(spark, sf_dir):
    log = A.game_log(spark, sf_dir).withColumn("stage", funnel_stage(F.col("event_name")))
    return log.select("event_timestamp", "stage", event_of_stage(F.col("stage")).alias("event"))


@query
def milestone_flags(spark, sf_dir):
    progress = A.raw_tables(spark, sf_dir).progress.withColumn(
        "furthest_stage", funnel_stage(F.col("furthest_event"))
    )
    flags = ["pc_flag", "la_flag", "ra_flag", "gc_flag", "lr_flag"]
    return learners.milestone_flags(progress).select(
        "cr_user_id", "country", "app_language", *flags
    )


@query
def game_progress(spark, sf_dir):
    gpc = N.game_progress(F.col("max_user_level"), F.col("max_game_level"))
    return A.raw_tables(spark, sf_dir).progress.select(
        "cr_user_id", "country", "app_language", gpc.alias("gpc")
    )


@query
def days_to_ra(spark, sf_dir):
    days = learners.days_to_ra(F.col("ra_date"), F.col("first_open"), F.col("first_event_date"))
    return A.raw_tables(spark, sf_dir).progress.select(
        "cr_user_id", "country", "app_language", days.alias("days_to_ra")
    )


@query
def active_span(spark, sf_dir):
    span = learners.active_span(
        F.col("last_event_date"), F.col("first_open"), F.col("first_event_date")
    )
    return A.raw_tables(spark, sf_dir).progress.select(
        "cr_user_id", "country", "app_language",
        span.alias("active_span"), N.clip_low(span, 0).alias("clipped_span"),
    )


@query
def language_alias(spark, sf_dir):
    names = ["ukranian", "malgache", "arabictest", "farsitest", "english", None]
    rows = A.plain_events(spark, sf_dir).select(
        "event_id", A.pick(names, F.col("k") % 6).alias("app_language")
    )
    return cleaning.clean_language(rows)


@query
def date_coerce(spark, sf_dir):
    k = F.col("k")
    month, day = F.lpad((k % 14).cast("string"), 2, "0"), F.lpad((k % 35).cast("string"), 2, "0")
    text = F.when(k % 10 == 9, "no date").otherwise(F.concat_ws("-", F.lit("2024"), month, day))
    rows = A.plain_events(spark, sf_dir).select("event_id", text.alias("first_open"))
    return fix_dates(rows, ["first_open", "last_event_date"])


@query
def cohort_filter(spark, sf_dir):
    countries = CohortFilter(A.COHORT_RANGE, ["english", "zulu"], ["NATION_1", "NATION_3", "NATION_7", "NATION_11"])
    users, reached = cohorts.filtered_cohort(A.tables(spark, sf_dir), "CR", countries)
    cols = ["cr_user_id", "country", "app_language", "first_open"]
    return users.select(F.lit("progress").alias("source"), *cols).unionByName(
        reached.select(F.lit("launches").alias("source"), *cols)
    )


@query
def date_presets(spark, sf_dir):
    """Learners whose first_open falls in each kind of date range."""
    choices = [
        ("All time", None), ("Select year", 2024), ("Select month", (12, 2023)),
        ("Select month", (1, 2024)), ("Select custom range", A.COHORT_RANGE),
        ("Last 7 days", None), ("Last 14 days", None), ("Last 30 days", None),
        ("Last 90 days", None),
    ]
    day, rows = F.col("first_open"), []
    for i, (option, value) in enumerate(choices):
        first, last = date_range(option, value, A.AS_OF)
        rows.append(F.struct(
            F.lit(i).alias("pos"), F.lit(option).alias("option"),
            F.lit(first).alias("first_day"), F.lit(last).alias("last_day"),
            F.count_if(day.between(F.lit(first), F.lit(last))).alias("learners"),
        ))
    return A.raw_tables(spark, sf_dir).legacy.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query
def campaign_names(spark, sf_dir):
    ads = A.facebook_ads(spark, sf_dir).select("campaign_name").distinct()
    return campaigns.add_country_and_language(ads)


# --- joins ---------------------------------------------------------------------------


@query
def join_max_level(spark, sf_dir):
    joined = learners.join_max_level(_events(spark, sf_dir), A.languages(spark))
    return joined.select(
        "cr_user_id", "app_language", "event_name", "event_timestamp", "max_game_level"
    )


@query
def join_dedup_dim(spark, sf_dir):
    joined = legacy.join_dedup_dim(_legacy_events(spark, sf_dir), A.languages(spark))
    return joined.select(
        "user_pseudo_id", "app_language", "event_name", "event_timestamp", "max_game_level"
    )


@query
def join_cohorts(spark, sf_dir):
    rows = launches.filter_launches(A.launch_log(spark, sf_dir), A.PROFILE, A.AS_OF)
    joined = launches.join_cohorts(
        rows.select("cr_user_id", "event_timestamp"), A.cohort_members(spark, sf_dir)
    )
    return joined


@query
def unnest_params(spark, sf_dir):
    return legacy.explode_params(A.legacy_log(spark, sf_dir)).select(
        "user_pseudo_id", "event_name", "event_timestamp", "param_key", "param_text"
    )


@query
def semi_join(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return matching.semi_join(
        raw.launches.select("cr_user_id", "user_pseudo_id", "app_language"), raw.progress, "cr_user_id"
    )


@query
def anti_join(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return matching.anti_join(
        raw.launches.select("cr_user_id", "user_pseudo_id", "app_language"), raw.progress, "cr_user_id"
    )


@query
def keyed_update(spark, sf_dir):
    raw, clean = A.built_tables(spark, sf_dir)
    rows = raw.launches.select(
        "cr_user_id", "user_pseudo_id", "country", "first_open", "app_language"
    )
    return matching.keyed_update(rows, clean.progress, "cr_user_id", "app_language")


# --- roll-ups ------------------------------------------------------------------------


@query
def cr_user_progress(spark, sf_dir):
    return learners.build_cr_user_progress(
        A.game_log(spark, sf_dir), A.languages(spark), A.PROFILE, A.AS_OF,
        staging=scratch_folder(spark, "game-events"),
    )


@query
def unity_user_progress(spark, sf_dir):
    return legacy.build_unity_user_progress(
        A.legacy_log(spark, sf_dir), A.languages(spark), A.PROFILE, A.AS_OF,
        staging=scratch_folder(spark, "legacy-events"),
    )


def _nights(events: DataFrame, folder: str) -> list[tuple[dt.date, DataFrame]]:
    """The events as three nights bring them: by day, but one in seven of all days comes with the last."""
    staged = stage(events, folder)
    late = F.pmod("event_timestamp", F.lit(7)) == 3
    first, second = (F.col("event_dt") < F.lit(day) for day in A.NIGHTS[:2])
    third = late | F.coalesce(~second, F.lit(True))
    kinds = [first & ~late, ~first & second & ~late, third]
    return [(day, staged.where(kind)) for day, kind in zip(A.NIGHTS, kinds)]


@query
def cr_user_progress_incremental(spark, sf_dir):
    base = scratch_folder(spark, "nights")
    for day, events in _nights(_events(spark, sf_dir), f"{base}/events"):
        table = incremental.advance_progress(events, A.languages(spark), A.PROFILE, base, day)
    return table


@query
def unity_user_progress_incremental(spark, sf_dir):
    base = scratch_folder(spark, "nights")
    for day, events in _nights(_legacy_events(spark, sf_dir).drop("event_name"), f"{base}/events"):
        table = incremental.advance_legacy(events, A.languages(spark), base, day)
    return table


@query
def session_stats_incremental(spark, sf_dir):
    base = scratch_folder(spark, "nights")
    stream = _stream(spark, sf_dir).withColumn("event_dt", micros_to_date(F.col("event_timestamp")))
    for day, events in _nights(stream, f"{base}/events"):
        stats = incremental.advance_sessions(events, "user_id", base, day, WIDE_GAP)
    return stats


@query
def app_launch(spark, sf_dir):
    return _plain_launches(launches.app_launch(
        A.launch_log(spark, sf_dir), A.cohort_members(spark, sf_dir), A.PROFILE, A.AS_OF
    ))


@query
def milestone_dates(spark, sf_dir):
    return learners.milestone_dates(_events(spark, sf_dir))


@query
def event_counts(spark, sf_dir):
    return learners.event_counts(_events(spark, sf_dir))


@query
def first_by_order(spark, sf_dir):
    return learners.first_by_order(
        _events(spark, sf_dir), ["app_language", "country"], ["user_pseudo_id", "hostname"]
    )


@query
def furthest_event(spark, sf_dir):
    return learners.furthest_event(_events(spark, sf_dir))


@query
def last_event(spark, sf_dir):
    return learners.last_event(_events(spark, sf_dir))


@query
def level_skips(spark, sf_dir):
    return legacy.level_skips(_legacy_events(spark, sf_dir))


# --- event order and sessions ----------------------------------------------------------


@query
def event_sequence(spark, sf_dir):
    return activity.event_sequence(
        _stream(spark, sf_dir), "user_id", "event_id", scratch_folder(spark, "event-order")
    )


def _tied_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with times cut to the day, and some events without any."""
    day = F.col("event_timestamp") - F.pmod("event_timestamp", F.lit(86_400_000_000))
    known = F.col("event_id") % 17 != 0
    return _stream(spark, sf_dir).withColumn("event_timestamp", F.when(known, day))


@query
def event_sequence_ties(spark, sf_dir):
    return activity.event_order(
        _tied_stream(spark, sf_dir), "user_id", "event_id", scratch_folder(spark, "event-order")
    )


@query
def event_deltas(spark, sf_dir):
    return activity.event_deltas(
        _stream(spark, sf_dir), "user_id", "event_id", scratch_folder(spark, "event-order")
    )


@query
def sessionize(spark, sf_dir):
    return activity.sessionize(_stream(spark, sf_dir), "user_id")


@query
def sessionize_3600(spark, sf_dir):
    return activity.sessionize(_stream(spark, sf_dir), "user_id", gap=WIDE_GAP)


@query
def mark_sessions(spark, sf_dir):
    deltas = activity.event_deltas(
        _stream(spark, sf_dir), "user_id", "event_id", scratch_folder(spark, "event-order")
    )
    return activity.mark_sessions(deltas, WIDE_GAP)


@query
def session_durations(spark, sf_dir):
    return activity.session_durations(_stream(spark, sf_dir), "user_id", gap=WIDE_GAP)


@query
def session_stats_cr(spark, sf_dir):
    return activity.session_stats_cr(_stream(spark, sf_dir), "user_id", gap=WIDE_GAP)


@query
def session_stats_unity(spark, sf_dir):
    return activity.session_stats_unity(_stream(spark, sf_dir), "user_id", gap=WIDE_GAP)


@query
def session_durations_stream(spark, sf_dir):
    """The stream of events in three arrivals, by time, each taken in as it comes."""
    base = scratch_folder(spark, "stream")
    rows = stage(_stream(spark, sf_dir).select("user_id", "event_timestamp"), f"{base}/rows")
    cuts = [F.unix_micros(F.lit(day).cast("timestamp")) for day in A.NIGHTS[:2]]
    ts = F.col("event_timestamp")
    for arrived in (ts < cuts[0], (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]):
        rows.where(arrived).write.mode("append").parquet(f"{base}/log")
        live = sessions.event_stream(spark, f"{base}/log", rows.schema)
        sessions.take_available(live, "user_id", f"{base}/out", f"{base}/state", gap=WIDE_GAP)
    return sessions.streamed_durations(spark, f"{base}/out", f"{base}/state", "user_id", "bigint")


# --- cleaning ----------------------------------------------------------------------------


@query
def best_row_cr(spark, sf_dir):
    return cleaning.best_row_cr(A.raw_tables(spark, sf_dir).progress)


@query
def best_row_unity(spark, sf_dir):
    """Furthest row of each (device, country) taken as rows of one legacy user per country."""
    users = A.raw_tables(spark, sf_dir).legacy.select(
        F.col("country").alias("user_pseudo_id"), F.col("user_pseudo_id").alias("device"),
        "max_user_level", "first_open",
    )
    return cleaning.best_row_unity(users)


@query
def duplicate_keys(spark, sf_dir):
    rows = A.raw_tables(spark, sf_dir).launches.select(
        "cr_user_id", "user_pseudo_id", "app_language", "first_open", "cohort_name"
    )
    return matching.mark_duplicates(rows, "user_pseudo_id")


@query
def dedupe_rows(spark, sf_dir):
    rows = A.raw_tables(spark, sf_dir).launches.select("cr_user_id", "app_language", "first_open")
    order = matching.descending(F.unix_date("first_open")) + matching.ascending("app_language")
    return matching.dedupe(rows, "cr_user_id", order)


@query
def single_language_users(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return cleaning.single_language_users(raw.launches, raw.progress)


@query
def single_language_launch(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return _plain_launches(cleaning.single_language_launch(raw.launches, raw.progress))


@query
def load_clean(spark, sf_dir):
    """Learner counts and sums of the three cleaned tables."""
    t = A.tables(spark, sf_dir)
    parts = {
        "progress": t.progress.agg(
            F.count(F.lit(1)).alias("n"), F.count("first_open").alias("with_first_open"),
            F.sum("max_user_level").alias("levels"), F.sum("active_span").alias("span"),
        ),
        "legacy": t.legacy.agg(
            F.count(F.lit(1)).alias("n"), F.count("first_open").alias("with_first_open"),
            F.sum("max_user_level").alias("levels"), F.sum("active_span").alias("span"),
        ),
        "launches": t.launches.agg(
            F.count(F.lit(1)).alias("n"), F.count("first_open").alias("with_first_open"),
        ),
    }
    return cohorts.concat_tagged(parts, "source")


@query
def clean_progress(spark, sf_dir):
    return A.tables(spark, sf_dir).progress


@query
def clean_legacy(spark, sf_dir):
    return A.tables(spark, sf_dir).legacy


@query
def clean_launches(spark, sf_dir):
    return _plain_launches(A.tables(spark, sf_dir).launches)


# --- cohorts and funnels -------------------------------------------------------------------


def _cr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cohorts.filtered_cohort(A.tables(spark, sf_dir), "CR", FILTER)


@query
def cohort_totals(spark, sf_dir):
    return funnel.cohort_totals(_cr(spark, sf_dir)[0])


@query
def funnel_by_group(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    return _rounded(funnel.funnel_by_group(users, reached, "country", "CR"), "GPP", "GPP_pct")


@query
def funnel_by_language(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    return _rounded(
        funnel.funnel_by_group(users, reached, "app_language", "CR", min_funnel=True), "GPP", "GPP_pct"
    )


@query
def funnel_unity(spark, sf_dir):
    users, _ = cohorts.filtered_cohort(A.tables(spark, sf_dir), "Unity", FILTER)
    return _rounded(funnel.funnel_by_group(users, None, "country", "Unity"), "GPP", "GPP_pct")


@query
def funnel_all_apps(spark, sf_dir):
    users, reached = cohorts.combined_cohorts(A.tables(spark, sf_dir), FILTER)
    return _rounded(funnel.funnel_by_group(users, reached, "country", "All"), "GPP", "GPP_pct")


@query
def lr_by_group(spark, sf_dir):
    return funnel.lr_by_group(_cr(spark, sf_dir)[1], "app_language", "CR")


@query
def sorted_funnel(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    table = funnel.funnel_by_group(users, reached, "country", "CR", min_funnel=True)
    return _rounded(funnel.sorted_funnel(table, "ra", "Percent"), "GPP", "GPP_pct")


@query
def top10(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    return _rounded(reports.top_stats(users, reached, "CR", "LA", "country"), "GPP", "GPP_pct")


@query
def app_funnel(spark, sf_dir):
    table = funnel.app_funnel(["CR", "Unity", "WBS-standalone"], A.tables(spark, sf_dir), FILTER, "large")
    return _rounded(table, "GPP", "GCA")


@query
def all_apps_metrics(spark, sf_dir):
    funnels = funnel.app_funnel(config.APPS, A.tables(spark, sf_dir), FILTER)
    return _rounded(funnel.all_apps_metrics(funnels), "GPP", "GCA")


@query
def global_metrics(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    table = funnel.funnel_by_group(users, reached, "app_language", "CR")
    return _rounded(funnel.global_metrics(table), "GPP", "GCA")


@query
def active_countries(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return launches.active_countries(raw.legacy, raw.progress)


# --- reports -----------------------------------------------------------------------------


@query
def country_map(spark, sf_dir):
    table = reports.report_map(A.tables(spark, sf_dir), "CR", FILTER, "LA")
    return _rounded(table, "GPP", "GPP_pct")


@query
def country_map_lr(spark, sf_dir):
    return reports.report_map(A.tables(spark, sf_dir), "All", FILTER, "LR")


@query
def funnel_steps(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    return reports.funnel_steps(users, reached, "CR", "large")


@query
def report_top_lr(spark, sf_dir):
    return reports.report_top(A.tables(spark, sf_dir), "CR", FILTER, "LR")


@query
def report_top_language_percent(spark, sf_dir):
    table = reports.report_top(A.tables(spark, sf_dir), "CR", FILTER, "LA", "app_language", percent=True)
    return _rounded(table, "GPP", "GPP_pct")


@query
def single_app_tiles(spark, sf_dir):
    return reports.single_app_tiles(A.tables(spark, sf_dir), "CR", FILTER)


@query
def single_app_steps(spark, sf_dir):
    return reports.single_app_steps(A.tables(spark, sf_dir), "CR", FILTER)


@query
def funnel_steps_medium(spark, sf_dir):
    users, reached = _cr(spark, sf_dir)
    return reports.funnel_steps(users, reached, "CR", "medium")


@query
def funnel_steps_all_apps(spark, sf_dir):
    return reports.funnel_steps_all_apps(A.tables(spark, sf_dir), FILTER)


@query
def engagement_tiles(spark, sf_dir):
    t = A.tables(spark, sf_dir)
    tiles = reports.engagement_tiles(t, "All", FILTER).unionByName(
        reports.engagement_tiles(t, "CR", FILTER)
    )
    return _rounded(tiles, "GPP", "GCA")


@query
def combined_cohorts(spark, sf_dir):
    users, reached = cohorts.combined_cohorts(A.tables(spark, sf_dir), FILTER)
    users = users.select(
        F.lit("progress").alias("source"), "app", "cr_user_id", "user_pseudo_id", "country",
        "app_language", "first_open", "max_user_level", "app_version",
    )
    reached = reached.select(
        F.lit("launches").alias("source"), "app", "cr_user_id", "user_pseudo_id", "country",
        "app_language", "first_open",
    )
    return users.unionByName(reached, allowMissingColumns=True)


# --- options -----------------------------------------------------------------------------------


@query
def app_versions_numeric(spark, sf_dir):
    return lists.app_version_list(A.app_versions(spark, sf_dir), numeric=True)


@query
def funnel_all_apps_coalesce(spark, sf_dir):
    users, reached = cohorts.combined_cohorts(A.tables(spark, sf_dir), FILTER)
    table = funnel.funnel_by_group(users, reached, "country", "All", user_key="coalesce")
    return _rounded(table, "GPP", "GPP_pct")


@query
def unity_user_progress_dedupe(spark, sf_dir):
    return legacy.build_unity_user_progress(
        A.legacy_log(spark, sf_dir), A.languages(spark), A.PROFILE, A.AS_OF,
        staging=scratch_folder(spark, "legacy-events"), dedupe_events=True,
    )


@query
def single_language_launch_strict(spark, sf_dir):
    raw = A.raw_tables(spark, sf_dir)
    return _plain_launches(cleaning.single_language_launch(raw.launches, raw.progress, strict_match=True))


# --- reports from merged aggregates -----------------------------------------------------------


@query
def funnel_bitmaps(spark, sf_dir):
    """Three cohorts of different days, each merged from the same daily sets."""
    t = A.tables(spark, sf_dir)
    base = scratch_folder(spark, "bitmaps")
    columns = ["cr_user_id", "first_open", "country", "app_language"]
    learners_ = t.progress.select(columns).unionByName(t.launches.select(columns))
    codes = stage(bitmaps.learner_codes(learners_, "cr_user_id", f"{base}/order"), f"{base}/codes")
    sets = bitmaps.funnel_bitmaps(t.progress, t.launches, codes)
    sets = bitmaps.FunnelBitmaps(*[
        stage(getattr(sets, name), f"{base}/{name}") for name in ("reached", "learners", "sums")
    ])
    parts = [
        bitmaps.funnel_of_bitmaps(sets, CohortFilter(days, A.COHORT_LANGUAGES)).withColumn("range_no", F.lit(n))
        for n, days in enumerate(A.BITMAP_RANGES)
    ]
    return _rounded(reduce(DataFrame.unionByName, parts), "GPP", "GPP_pct")


def _cube(spark: SparkSession, sf_dir: str, app: str) -> cube.ReportCube:
    return cube.report_cube(A.tables(spark, sf_dir), app, FILTER, scratch_folder(spark, "cube"))


@query
def cube_country_map(spark, sf_dir):
    return _rounded(_cube(spark, sf_dir, "CR").map("LA"), "GPP", "GPP_pct")


@query
def cube_country_map_lr(spark, sf_dir):
    return _cube(spark, sf_dir, "All").map("LR")


@query
def cube_top_language_percent(spark, sf_dir):
    return _rounded(_cube(spark, sf_dir, "CR").top("LA", "app_language", percent=True), "GPP", "GPP_pct")


@query
def cube_funnel_unity(spark, sf_dir):
    return _rounded(_cube(spark, sf_dir, "Unity").funnel(), "GPP", "GPP_pct")


@query
def cube_funnel_all_apps(spark, sf_dir):
    return _rounded(_cube(spark, sf_dir, "All").funnel(), "GPP", "GPP_pct")


@query
def cube_steps(spark, sf_dir):
    return _cube(spark, sf_dir, "CR").steps("large")


@query
def cube_tiles(spark, sf_dir):
    return _cube(spark, sf_dir, "CR").tiles()


# --- sinks, read back ------------------------------------------------------------------------


@query
def export_read_back(spark, sf_dir):
    base = scratch_folder(spark, "exported")
    export_run(A.raw_tables(spark, sf_dir).launches, base, A.RUN_DATE)
    return _plain_launches(load_latest_run(spark, base))


@query
def table_read_back(spark, sf_dir):
    path = scratch_folder(spark, "rebuilt")
    for table in (A.raw_tables(spark, sf_dir).legacy.limit(0), A.raw_tables(spark, sf_dir).legacy):
        save_table(table, path=path)
    return spark.read.parquet(path)


@query
def csv_read_back(spark, sf_dir):
    path, users = scratch_folder(spark, "csv"), _cr(spark, sf_dir)[0]
    export_csv(users, path)
    return spark.read.schema(users.schema).csv(path, header=True)


# --- campaigns -----------------------------------------------------------------------------


def _campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    google = spend.google_spend(A.google_stats(spark, sf_dir), A.google_campaigns(spark, sf_dir))
    facebook = spend.facebook_spend(A.facebook_ads(spark, sf_dir), newest_first=False)
    return campaigns.all_campaigns(google, facebook)


@query
def campaign_rollup(spark, sf_dir):
    return _rounded(campaigns.rollup_campaigns(_campaigns(spark, sf_dir)), "cost", digits=2)


@query
def campaigns_by_date(spark, sf_dir):
    rolled = campaigns.campaigns_by_date(_campaigns(spark, sf_dir), A.SPEND_RANGE)
    return _rounded(rolled, "cost", digits=2)


@query
def campaign_costs(spark, sf_dir):
    rolled = campaigns.campaigns_by_date(_campaigns(spark, sf_dir), A.SEGMENT_RANGE)
    return campaigns.campaign_table(rolled, A.tables(spark, sf_dir), A.SEGMENT_RANGE)


def queries() -> dict[str, Query]:
    return dict(_queries)
