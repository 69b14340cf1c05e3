"""Load the newest snapshots and clean them into the tables that reports read."""

from __future__ import annotations

from pyspark.sql import SparkSession

from readtrail.operators.cleaning import clean_tables
from readtrail.operators.cohorts import LearnerTables
from readtrail.session import apply_settings, run_together
from readtrail.sources.snapshots import check_runs, newest_run, stage

TABLES = ["cr_user_progress", "unity_user_progress", "cr_app_launch"]


KEYS = {"cr_user_progress": "cr_user_id", "unity_user_progress": "user_pseudo_id", "cr_app_launch": "cr_user_id"}


def load_raw(
    spark: SparkSession, base: str, max_null_share: float = 1.0, max_duplicate_share: float = 1.0
) -> LearnerTables:
    """Newest published run of the three tables under ``base``.

    Raises if one is empty, or has more rows without a key, or with a key that another row
    has, than the given shares.  Those counts were taken when the run was written.
    """
    runs = {name: newest_run(spark, f"{base}/{name}") for name in TABLES}
    check_runs(runs, KEYS, max_null_share, max_duplicate_share)
    return LearnerTables(*[run.read(spark) for run in runs.values()])


def load_clean(
    spark: SparkSession, base: str, strict_match: bool = False, staging: str | None = None
) -> LearnerTables:
    """Newest run of the three tables under ``base``, cleaned.

    Many reports read the same cleaned tables: with ``staging``, a shared folder, they
    are written once and read from there, instead of being cleaned anew by each report.
    """
    raw = load_raw(apply_settings(spark), base)
    cleaned = clean_tables(
        raw.progress, raw.legacy, raw.launches, strict_match, staging and f"{staging}/learner_pairs"
    )
    if staging is None:
        return LearnerTables(*cleaned)
    return LearnerTables(*run_together(*[
        lambda name=name, df=df: stage(df, f"{staging}/{name}") for name, df in zip(TABLES, cleaned)
    ]))
