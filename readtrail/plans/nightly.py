"""Nightly build: raw logs → learner tables → run-dated snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail.config import AppProfile
from readtrail.functions.dates import export_day
from readtrail.operators import launches
from readtrail.operators.learners import (
    game_events,
    is_game_event,
    is_known_game_event,
    progress_table,
)
from readtrail.operators.legacy import build_unity_user_progress, union_sources
from readtrail.plans.load_clean import KEYS
from readtrail.session import apply_settings, remove_folder, run_together, scratch_folder
from readtrail.sources.snapshots import export_run, key_metrics


def split_log(
    log: DataFrame, profile: AppProfile, as_of: dt.date | None, staging: str
) -> tuple[DataFrame, DataFrame]:
    """Filtered game events and filtered launches of the web log, from one scan of it.

    Both are written to ``staging`` as flat rows, each kind in a folder of its own.
    """
    starts = launches.is_launch_event(profile)
    flat = game_events(
        log.where(is_game_event() | starts), launches.launched_url().alias("url"), starts.alias("starts")
    )
    kind = F.when(F.col("starts"), F.when(launches.is_known_launch(profile, as_of), "launch")).otherwise(
        F.when(is_known_game_event(profile, as_of), "game")
    )
    marked = flat.withColumn("kind", kind).where("kind IS NOT NULL").drop(
        "page_location", "success_or_failure", "starts"
    )
    marked.write.mode("overwrite").partitionBy("kind").parquet(staging)
    rows = log.sparkSession.read.schema(marked.schema).parquet(staging)
    games = rows.where("kind = 'game'").drop("kind", "url")
    return games, launches.with_language(rows.where("kind = 'launch'"))


def run_nightly(
    log: DataFrame,
    legacy_logs: list[DataFrame],
    languages: DataFrame,
    cohorts: DataFrame,
    profile: AppProfile,
    staging: str | None,
    base: str,
    as_of: dt.date | None = None,
    run_date: dt.date | None = None,
    lenient: bool = False,
) -> dict[str, str]:
    """Build the three learner tables and publish each as a run of ``<base>/<name>``.

    Filtered events are written once as narrow flat rows, so each nested raw log is
    scanned once: the web log's game events and launches in one pass, told apart by the
    folder they go to.  They lie in ``staging`` (None: a folder of its own under
    spark.checkpoint.dir) and are removed at the end.  Both dates are settled at the start,
    so all tables of a night bear one.  Gives the paths by table name.
    """
    spark = apply_settings(log.sparkSession)
    run_date = run_date or export_day()
    as_of = as_of or dt.datetime.now(dt.timezone.utc).date()
    staging = staging or scratch_folder(spark, "nightly")
    try:
        games, starts = split_log(log, profile, as_of, f"{staging}/web_events")
        legacy = union_sources(legacy_logs)
        builds = {
            "cr_user_progress": lambda: progress_table(games, languages, profile),
            "unity_user_progress": lambda: build_unity_user_progress(
                legacy, languages, profile, as_of, f"{staging}/legacy_events", lenient=lenient
            ),
            "cr_app_launch": lambda: launches.launch_table(starts, cohorts),
        }
        paths = run_together(*[
            lambda name=name, build=build: export_run(build(), f"{base}/{name}", run_date, key_metrics(KEYS[name]))
            for name, build in builds.items()
        ])
        return dict(zip(builds, paths))
    finally:
        remove_folder(spark, staging)
