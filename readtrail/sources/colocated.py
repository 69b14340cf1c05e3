"""Learner tables stored so that matches on the learner need no shuffle.

A table is written in a fixed number of buckets by its never-NULL key, sorted within each.
Operators that match or group on that key find two such tables side by side: bucket n of one
meets bucket n of the other, and no row moves.  All tables that are to meet need the same
number of buckets; a multiple of the cluster's cores, so that a bucket fits a task.

Learner tables have a few rows per learner, so buckets are even, but for rows without an id,
which share a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from readtrail.operators.matching import stored_key, with_stored_key


def save_by_key(df: DataFrame, key: str, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Rebuild the catalog table ``name``, laid out by ``key``; gives it read back.

    Rows are brought together first, so a bucket is one file.
    """
    columns = stored_key(key)
    writer = (
        with_stored_key(df, key).repartition(buckets, *columns).write.format("parquet").mode("overwrite")
        .bucketBy(buckets, *columns).sortBy(*columns)
    )
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def without_layout(df: DataFrame, key: str) -> DataFrame:
    """The table's own columns."""
    return df.drop(*stored_key(key))
