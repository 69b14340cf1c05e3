"""Daily advertising spend in one shape for both sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.functions.numbers import round_half_even

_COLUMNS = [
    "campaign_id", "segment_date", "campaign_name", "cost", "campaign_start_date",
    "campaign_end_date",
]


def google_spend(
    stats: DataFrame, campaigns: DataFrame, since: dt.date = config.SPEND_FIRST_DAY
) -> DataFrame:
    """Spend per campaign and day; cost in micros becomes currency, repeated rows collapse."""
    recent = stats.where(F.col("segments_date") >= F.lit(since)).select(
        "campaign_id",
        F.col("segments_date").alias("segment_date"),
        F.col("metrics_cost_micros").alias("cost"),
    )
    named = campaigns.select(
        "campaign_id", "campaign_name", "campaign_start_date", "campaign_end_date"
    )
    rows = recent.join(named, "campaign_id").select(*_COLUMNS).dropDuplicates()
    return rows.withColumns({
        "campaign_id": F.regexp_replace(F.col("campaign_id").cast("string"), ",", ""),
        "cost": round_half_even(F.col("cost") / F.lit(1_000_000), 2),
        "source": F.lit("Google"),
    })


def facebook_spend(
    ads: DataFrame, since: dt.date = config.SPEND_FIRST_DAY, newest_first: bool = False
) -> DataFrame:
    """Spend per campaign and day; ``newest_first`` sorts the whole table, for display."""
    rows = (
        ads.where(F.col("data_date_start") >= F.lit(since))
        .select(
            F.col("campaign_id").cast("string").alias("campaign_id"),
            F.col("data_date_start").alias("segment_date"),
            "campaign_name",
            F.col("spend").alias("cost"),
            F.col("start_time").alias("campaign_start_date"),
            F.col("end_time").alias("campaign_end_date"),
            F.lit("Facebook").alias("source"),
        )
    )
    return rows.orderBy(F.col("segment_date").desc()) if newest_first else rows
