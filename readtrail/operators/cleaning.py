"""Cleaning of the learner tables: aliases, dates, one row per learner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.functions.dates import fix_dates
from readtrail.functions.numbers import clip_low
from readtrail.operators.matching import (
    KEY,
    ascending,
    best_row,
    descending,
    first_rows,
    keyed,
    mark_duplicates,
    row_in_order,
)
from readtrail.sources.snapshots import stage


def clean_language(df: DataFrame, column: str = "app_language") -> DataFrame:
    """Repair the known misspellings of language names."""
    return df.replace(config.LANGUAGE_ALIASES, subset=[column])


def best_row_unity(users: DataFrame) -> DataFrame:
    """Row with the highest level of each legacy user; rows without a user id go."""
    known = users.where(F.col("user_pseudo_id").isNotNull())
    order = descending(F.col("max_user_level")) + ascending("first_open")
    return best_row(known, "user_pseudo_id", order)


def best_row_cr(users: DataFrame) -> DataFrame:
    """Furthest row of each learner over its countries and languages."""
    return _furthest_rows(users).select("first.*")


def _furthest_rows(users: DataFrame) -> DataFrame:
    """KEY and, as ``first``, the furthest row of each learner.

    Finished a level first, then highest level, then furthest stage.  Ties go to the
    row with most events, the order the table is reported in, then by country and
    language.
    """
    named = users.withColumn(
        "furthest_event", F.coalesce(F.col("furthest_event"), F.lit("unknown"))
    )
    event = F.col("furthest_event")
    # a session start ranks with the unknown events
    rank = F.lit(None).cast("int")
    for name, number in config.STAGE_NUMBERS.items():
        if number > 0:
            rank = F.when(event == name, F.lit(number)).otherwise(rank)
    order = (
        [event != "level_completed"]
        + descending(F.col("max_user_level"))
        + descending(rank)
        + descending(F.col("engagement_event_count"))
        + ascending("country")
        + ascending("app_language")
    )
    return first_rows(named, "cr_user_id", order)


def _launch_choices(launches: DataFrame, best: DataFrame, strict_match: bool) -> DataFrame:
    """Per learner (KEY): has_dup, and one launch row, ``pick``, with ``fits``.

    Rows of repeated devices that have a language (and agree with progress, if the match
    is strict) come first, then other rows of repeated devices, then the rest; within each
    the newest first_open, then the earliest launch, country, language and device.
    """
    order = (
        descending(F.unix_date("first_open"))
        + ascending("first_launch_ts")
        + ascending("country")
        + ascending("app_language")
        + ascending("user_pseudo_id")
    )
    row = row_in_order(launches, order)
    marked = keyed(mark_duplicates(launches, "user_pseudo_id", "dup"), "cr_user_id")
    fits = F.col("dup") & F.col("app_language").isNotNull()
    if strict_match:
        marked = marked.join(best.select(
            *KEY, F.col("first.app_language").alias("_language"), F.col("first.country").alias("_country"),
        ), KEY, "left")
        same = (F.col("app_language") == F.col("_language")) & F.col("country").eqNullSafe(F.col("_country"))
        fits = fits & F.coalesce(same, F.lit(False))
    return marked.groupBy(*KEY).agg(
        F.max("dup").alias("has_dup"),
        F.min(F.struct((~F.col("dup")).alias("single"), (~fits).alias("unfit"), row.alias("kept"))).alias("choice"),
    ).select(*KEY, "has_dup", (~F.col("choice.unfit")).alias("fits"), F.col("choice.kept.row").alias("pick"))


def learner_pairs(
    launches: DataFrame, users: DataFrame, strict_match: bool = False, staging: str | None = None
) -> DataFrame:
    """Per learner its furthest progress row, ``first``, and its launch choice; either may be NULL.

    Both cleaned tables are read off this; ``staging`` as in :func:`stage`.
    """
    best = _furthest_rows(users)
    return stage(best.join(_launch_choices(launches, best, strict_match), KEY, "full"), staging)


def users_of(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Progress table with one row per learner.

    For app CR, first_open becomes that of the learner's launch row, NULL without one.
    """
    # a learner with progress gets no fallback row
    launch_day = F.when(F.col("fits") | ~F.col("has_dup"), F.col("pick.first_open"))
    first_open = F.when(F.col("first.app") == "CR", launch_day).otherwise(F.col("first.first_open"))
    known = pairs.where(F.col("first").isNotNull())
    return known.withColumn("_first_open", first_open).select("first.*", "_first_open").withColumn(
        "first_open", F.col("_first_open")
    ).select(*columns)


def launches_of(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Launch table with one row per learner.

    A learner none of whose devices repeats keeps its first row, in the language of
    its progress row if it has one.  Otherwise its first repeated-device row with a
    language is taken as it is; failing that, a learner without progress gets its
    first such row, and a learner with progress gets none.
    """
    known, dup = F.col("first").isNotNull(), F.col("has_dup")
    language = F.when(~dup & known, F.col("first.app_language")).otherwise(F.col("pick.app_language"))
    chosen = pairs.where(F.col("pick").isNotNull() & (~dup | F.col("fits") | ~known))
    return chosen.withColumn("_language", language).select("pick.*", "_language").withColumn(
        "app_language", F.col("_language")
    ).select(*columns)


def single_language_users(
    launches: DataFrame, users: DataFrame, strict_match: bool = False
) -> DataFrame:
    """See :func:`users_of`."""
    return users_of(learner_pairs(launches, users, strict_match), users.columns)


def single_language_launch(
    launches: DataFrame, users: DataFrame, strict_match: bool = False
) -> DataFrame:
    """See :func:`launches_of`; ``strict_match`` asks that a repeated device's row agree with
    the progress row in language and country."""
    return launches_of(learner_pairs(launches, users, strict_match), launches.columns)


def clean_tables(
    progress: DataFrame, legacy: DataFrame, launches: DataFrame, strict_match: bool = False,
    staging: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean the three learner tables: (progress, legacy, launches)."""
    progress = clean_language(fix_dates(progress, ["first_open", "last_event_date"]))
    launches = clean_language(fix_dates(launches, ["first_open"]))
    legacy = best_row_unity(fix_dates(legacy, ["first_open", "la_date", "last_event_date"]))
    pairs = learner_pairs(launches, progress, strict_match, staging)
    users = users_of(pairs, progress.columns)
    users = users.withColumn("active_span", clip_low(F.col("active_span"), 0))
    return users, legacy, launches_of(pairs, launches.columns)
