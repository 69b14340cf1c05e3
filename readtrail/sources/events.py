"""Event-log scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readtrail import schema
from readtrail.operators.legacy import union_sources

__all__ = ["event_log", "scan_events", "union_sources"]


def scan_events(
    log: DataFrame, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """Events of a range of days (inclusive) by event_date, which is yyyymmdd text."""
    # over a partition column this test is made on folder names, before any file is read
    if since is not None:
        log = log.where(F.col("event_date") >= since.strftime("%Y%m%d"))
    if until is not None:
        log = log.where(F.col("event_date") <= until.strftime("%Y%m%d"))
    return log


def event_log(
    spark: SparkSession, base: str, since: dt.date | None = None, until: dt.date | None = None,
    log_schema: StructType = schema.EVENT_LOG,
) -> DataFrame:
    """Parquet event log partitioned by event_date, all days or a range of them.

    The declared schema is narrower than a full log: of the nested values only the
    fields it names are read.  It also keeps event_date text, where reading it off the
    folder names would make it a number.
    """
    return scan_events(spark.read.schema(log_schema).parquet(base), since, until)
