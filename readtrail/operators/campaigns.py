"""Advertising campaigns: names, roll-up, spend and cost per learner."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.functions import numbers as N
from readtrail.functions.params import campaign_country, campaign_language
from readtrail.operators.cohorts import CohortFilter, LearnerTables, filtered_cohort
from readtrail.operators.funnel import step_condition


def add_country_and_language(df: DataFrame) -> DataFrame:
    """Read country and language out of names like '<text>: <language> - <country>'."""
    name = F.col("campaign_name")
    return df.withColumns({
        "country": campaign_country(name), "app_language": campaign_language(name),
    })


def all_campaigns(google: DataFrame, facebook: DataFrame) -> DataFrame:
    """Daily spend of both sources in one table, country and language parsed."""
    return add_country_and_language(google.unionByName(facebook, allowMissingColumns=True))


def _newest(column: str) -> Column:
    """Value of the newest day that has one."""
    key = F.struct(
        F.coalesce(F.unix_date("segment_date"), F.lit(-(2**31))).alias("day"),
        F.coalesce(F.col("campaign_name"), F.lit("")).alias("name"),
        F.col(column).alias("value"),
    )
    return F.max_by(column, F.when(F.col(column).isNotNull(), key)).alias(column)


def rollup_campaigns(df: DataFrame) -> DataFrame:
    """One row per campaign: summed cost, and the rest as of its newest day.

    Each attribute is the newest one that is known.  A campaign with a single row
    keeps that row, also one without an id; several rows without an id are dropped.
    Rows of the same day are ordered by name, then by value; the greatest wins.
    """
    attributes = [
        c for c in ("campaign_name", "campaign_start_date", "campaign_end_date", "source",
                    "country", "app_language") if c in df.columns
    ]
    # a campaign's attributes rarely change: fold equal ones first, with numbers and
    # dates only in the aggregate, then pick among the few variants
    variants = df.groupBy("campaign_id", *attributes).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("cost").alias("cost"),
        F.max("segment_date").alias("segment_date"),
    )
    n = F.col("n_rows")
    return (
        variants.groupBy("campaign_id")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("cost").alias("cost"), *map(_newest, attributes))
        .where(F.col("campaign_id").isNotNull() | (n == 1))
        .withColumn(
            "cost",
            F.when(n > 1, F.coalesce(F.col("cost"), F.lit(0.0))).otherwise(F.col("cost")),
        )
        .drop("n_rows")
    )


def campaigns_by_date(df: DataFrame, daterange: tuple[dt.date, dt.date]) -> DataFrame:
    """Campaigns with spend in a range of days (inclusive), rolled up."""
    start, end = daterange
    return rollup_campaigns(df.where(F.col("segment_date").between(F.lit(start), F.lit(end))))


def spend_by_segment(campaigns: DataFrame) -> DataFrame:
    """Spend per (country, language), 2 decimals; segments with a NULL part are left out."""
    known = campaigns.where(F.col("country").isNotNull() & F.col("app_language").isNotNull())
    cost = N.round_half_even(F.coalesce(F.sum("cost"), F.lit(0.0)), 2)
    return known.groupBy("country", "app_language").agg(cost.alias("cost"))


_COST_STATS = ["LR", "PC", "LA", "RA"]


def segment_totals(tables: LearnerTables, daterange: tuple[dt.date, dt.date] | None) -> DataFrame:
    """CR totals per (country, language): LR from launches, the rest from progress."""
    segment = ["country", "app_language"]
    users, launches = filtered_cohort(tables, "CR", CohortFilter(daterange))
    reached = launches.groupBy(*segment).agg(F.count(F.lit(1)).alias("LR"))
    later = users.groupBy(*segment).agg(
        *[F.count_if(step_condition(s)).alias(s) for s in _COST_STATS[1:]]
    )
    both = reached.unionByName(later, allowMissingColumns=True)
    return both.groupBy(*segment).agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _COST_STATS]
    )


def campaign_table(
    campaigns: DataFrame, tables: LearnerTables, daterange: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Spend, learners, cost per learner and conversion per (country, language).

    ``<step>C`` is the cost of one learner at that step, 0 when there is none;
    conversions are whole percent of LR, 0 when LR is 0.
    """
    spend = spend_by_segment(campaigns).withColumn("app_language", F.lower("app_language"))
    joined = spend.join(segment_totals(tables, daterange), ["country", "app_language"], "left")
    joined = joined.fillna(0, _COST_STATS)
    columns = [F.col("country"), F.col("app_language"), F.col("cost")]
    for step in _COST_STATS:
        n = F.col(step)
        each = N.round_half_even(F.try_divide(F.col("cost"), n), 2)
        columns += [n, F.when(n == 0, 0.0).otherwise(each).alias(f"{step}C")]
    for step in ["PC", "LA", "RA"]:
        share = N.round_half_even(F.try_divide(F.col(step), F.col("LR")), 2) * 100
        columns.append(F.when(F.col("LR") == 0, 0.0).otherwise(share).alias(f"{step}_LR %"))
    return joined.select(*columns)
