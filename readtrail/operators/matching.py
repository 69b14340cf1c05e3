"""Key-matching and pick-one-row operators.

Keys compare NULL-safe: a NULL key equals a NULL key, as in the data-frame
semantics these jobs reproduce.  Picking one row per key is an aggregate, not a
window, so a key that owns a large share of the rows is reduced before it is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# a key that is never NULL: its text, and whether it was NULL
KEY = ["_key", "_no_key"]


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Add the columns KEY for ``key``.

    Plain equality on them is NULL-safe, and grouping by them leaves the rows where a join
    on them wants them, which NULL-safe equality on the key itself would not.  A table that
    was stored by this key has them already, under names of their own (:func:`stored_key`).
    """
    stored = stored_key(key)
    if set(stored) <= set(df.columns):
        return df.withColumns({k: F.col(s) for k, s in zip(KEY, stored)})
    return df.withColumns(dict(zip(KEY, _never_null(key))))


def _never_null(key: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()]


def stored_key(key: str) -> list[str]:
    """Columns by which a stored table is laid out for matches on ``key``."""
    return [f"{key}__key", f"{key}__null"]


def with_stored_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns(dict(zip(stored_key(key), _never_null(key))))


def match_keys(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on an equally named key, NULL equal to NULL; the left key is kept."""
    joined = keyed(left, key).join(keyed(right, key).drop(key), KEY, how)
    return joined.drop(*KEY)


def _keys_of(df: DataFrame, key: str) -> DataFrame:
    return keyed(df, key).select(*KEY).distinct()


def semi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key occurs in right."""
    return keyed(left, key).join(_keys_of(right, key), KEY, "left_semi").drop(*KEY)


def anti_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key does not occur in right."""
    return keyed(left, key).join(_keys_of(right, key), KEY, "left_anti").drop(*KEY)


def keyed_update(
    df: DataFrame, other: DataFrame, key: str, column: str, when: Column | None = None,
    unmatched_null: bool = False,
) -> DataFrame:
    """Overwrite ``column`` with its value in ``other`` (one row per key there).

    Only rows satisfying ``when`` change.  A row without a match keeps its value,
    or becomes NULL with ``unmatched_null``.
    """
    update = keyed(other, key).select(*KEY, F.col(column).alias("_new"), F.lit(True).alias("_matched"))
    change = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    if not unmatched_null:
        change = change & F.col("_matched").isNotNull()
    joined = keyed(df, key).join(update, KEY, "left")
    value = F.when(change, F.col("_new")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*df.columns)


def mark_duplicates(df: DataFrame, key: str, name: str = "is_duplicate") -> DataFrame:
    """Flag every row whose key occurs more than once (NULL counts as a key)."""
    rows = keyed(df, key)
    repeated = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    flagged = rows.join(repeated, KEY, "left").withColumn(name, F.col("_n").isNotNull())
    return flagged.drop(*KEY, "_n")


def ascending(column: str) -> list[Column]:
    """Sort keys for a struct: smallest first, NULL last."""
    return [F.col(column).isNull(), F.col(column)]


def descending(number: Column) -> list[Column]:
    """Sort keys for a struct: largest number first, NULL last."""
    return [number.isNull(), -number]


def _as_struct(parts: list[Column], prefix: str) -> Column:
    return F.struct(*[part.alias(f"{prefix}{i}") for i, part in enumerate(parts)])


def row_in_order(df: DataFrame, order: list[Column]) -> Column:
    """The whole row behind its sort keys; min() of it is the first row in order.

    Equal sort keys fall back to comparing the row itself, so the pick is stable.
    """
    return F.struct(_as_struct(order, "k").alias("order"), F.struct(*df.columns).alias("row"))


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """KEY and, as the struct ``first``, the first row per key in the given order."""
    first = F.min(row_in_order(df, order))
    return keyed(df, key).groupBy(*KEY).agg(first.alias("_first")).select(*KEY, F.col("_first.row").alias("first"))


def best_row(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    return first_rows(df, key, order).select("first.*")


def dedupe(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Drop duplicates by key, keeping the first row in the given order."""
    return best_row(df, key, order)
