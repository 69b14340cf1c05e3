"""Event order, gaps and sessions per user, safe for a user who owns most of the log.

No window here runs over all events of a user.  Events are first folded into
*slices*: runs of ``gap + 1`` seconds of the clock.  Two events of one slice are
at most ``gap`` whole seconds apart, so a slice always lies inside one session
and its first time, last time and count are all that sessions need.  The fold is
an ordinary aggregate (combined before the shuffle, keyed by user and slice), and
what is left per user is bounded by the length of the history, not by the number
of events: five years of 121-second slices are 1.3 million rows.

The bound is for the usual gap; it grows as the gap shrinks.

Where sessions are wanted per event, slice results are joined back on (user, slice), a key
that spreads a busy user over the whole cluster.  Where the order of events itself is
wanted, they are range-partitioned in that order.  Events without a user id belong to one
nameless user.  Event times are epoch microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from readtrail import config
from readtrail.functions.dates import whole_seconds
from readtrail.sources.snapshots import stage

_NO_TIME = -(1 << 62)  # slice of events without a time, before all others
_USER = ["_user", "_nameless"]


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def _named(events: DataFrame, key: str) -> DataFrame:
    """Add a never-NULL form of the user id.

    Plain equality on it serves grouping, windows and joins alike, so one shuffle can
    serve several of them; NULL-safe join keys would each need a shuffle of their own.
    """
    return events.withColumns({
        "_user": F.coalesce(F.col(key).cast("string"), F.lit("")), "_nameless": F.col(key).isNull(),
    })


def _slice_start(ts: str, gap: int) -> Column:
    width = (gap + 1) * 1_000_000
    return F.coalesce(F.col(ts) - F.pmod(F.col(ts), F.lit(width)), F.lit(_NO_TIME))


def activity_slices(
    events: DataFrame,
    key: str | list[str],
    ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
    extra: list[Column] | None = None,
) -> DataFrame:
    """One row per (user, slice): first_us, last_us, n_events and ``extra`` aggregates."""
    return events.groupBy(*_keys(key), _slice_start(ts, gap).alias("slice")).agg(
        F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"),
        F.count(F.lit(1)).alias("n_events"),
        *(extra or []),
    )


def session_slices(
    slices: DataFrame, key: str | list[str], gap: int = config.SESSION_GAP_SECONDS
) -> DataFrame:
    """Add seconds_since_last, is_new_session and session_id to slices.

    A session starts at a user's first slice and wherever more than ``gap`` whole
    seconds passed since ``prev_us``, the time of the event before.
    """
    in_order = Window.partitionBy(*_keys(key)).orderBy("slice")
    marked = slices.withColumn("prev_us", F.lag("last_us").over(in_order)).withColumn(
        "seconds_since_last", whole_seconds(F.col("first_us"), F.col("prev_us"))
    )
    starts = F.col("seconds_since_last").isNull() | (F.col("seconds_since_last") > gap)
    return marked.withColumn("is_new_session", F.when(starts, 1).otherwise(0)).withColumn(
        "session_id", F.sum("is_new_session").over(in_order)
    )


def sessionize(
    events: DataFrame,
    key: str,
    ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
) -> DataFrame:
    """Every event with the number of the session it belongs to (1, 2, … per user).

    Events at the same moment share a session; events without a time make up one, the first.
    """
    sliced = _named(events, key).withColumn("slice", _slice_start(ts, gap))
    sessions = session_slices(activity_slices(sliced, _USER, ts, gap), _USER, gap)
    numbers = sessions.select(*_USER, "slice", "session_id")
    return sliced.join(numbers, [*_USER, "slice"], "left").select(*events.columns, "session_id")


def mark_sessions(deltas: DataFrame, gap: int = config.SESSION_GAP_SECONDS) -> DataFrame:
    """Flag the events that open a session, given :func:`event_deltas`."""
    since = F.col("seconds_since_last")
    return deltas.withColumn(
        "is_new_session", F.when(since.isNull() | (since > gap), 1).otherwise(0)
    )


def _sum_before(column: str, window: WindowSpec) -> Column:
    """Sum over the rows before the current one, 0 for the first."""
    earlier = F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(earlier, F.lit(0))


def event_order(
    events: DataFrame, key: str, tie: str, staging: str, ts: str = "event_timestamp"
) -> DataFrame:
    """Every event with rn, its number 1, 2, … among its user's events, and prev_us, the time
    of the one before it (NULL for the first).

    Events are ordered by time, those without a time first, and by the unique column
    ``tie`` within a moment.  They are range-partitioned in that order, so a busy user and
    a pile of equal times spread over many partitions, and written to ``staging``, a
    shared folder, with the number of their partition.  A window runs over the events of
    one user in one partition; one row per (user, partition) carries counts onward.
    """
    order = [F.col(ts).asc_nulls_first(), F.col(tie)]
    ranged = _named(events, key).repartitionByRange(*_USER, *order)
    staged = stage(ranged.withColumn("_part", F.spark_partition_id()), staging)
    parts = staged.groupBy(*_USER, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_last"))
    by_part = Window.partitionBy(*_USER).orderBy("_part")
    before = parts.select(
        *_USER, "_part", _sum_before("_n", by_part).alias("_before"), F.lag("_last").over(by_part).alias("_prev")
    )
    in_part = Window.partitionBy(*_USER, "_part").orderBy(*order)
    place = F.row_number().over(in_part)
    return staged.join(before, [*_USER, "_part"]).select(
        *events.columns,
        (F.col("_before") + place).cast("bigint").alias("rn"),
        F.when(place == 1, F.col("_prev")).otherwise(F.lag(ts).over(in_part)).alias("prev_us"),
    )


def event_sequence(
    events: DataFrame, key: str, tie: str, staging: str, ts: str = "event_timestamp"
) -> DataFrame:
    """Number the events of each user 1, 2, … by time, then ``tie``; see :func:`event_order`."""
    return event_order(events, key, tie, staging, ts).drop("prev_us")


def event_deltas(
    events: DataFrame, key: str, tie: str, staging: str, ts: str = "event_timestamp"
) -> DataFrame:
    """Every event with prev_us, the time of the user's event before it in the order of
    :func:`event_order`, and seconds_since_last, the whole seconds in between."""
    ordered = event_order(events, key, tie, staging, ts).drop("rn")
    return ordered.withColumn("seconds_since_last", whole_seconds(F.col(ts), F.col("prev_us")))


def session_durations(
    events: DataFrame,
    key: str,
    ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
    extra: list[Column] | None = None,
    extra_merge: list[Column] | None = None,
) -> DataFrame:
    """One row per (user, session): its length in whole seconds and its event count.

    ``extra`` are further aggregates over events; ``extra_merge`` folds their slice
    results into the session.
    """
    marked = session_slices(activity_slices(events, key, ts, gap, extra), key, gap)
    return (
        marked.groupBy(key, "session_id")
        .agg(
            F.min("first_us").alias("start_us"),
            F.max("last_us").alias("end_us"),
            F.sum("n_events").alias("n_events"),
            *(extra_merge or []),
        )
        .withColumn("session_duration_sec", whole_seconds(F.col("end_us"), F.col("start_us")))
        .drop("start_us", "end_us")
    )


def _minutes(seconds: Column) -> Column:
    return F.round(seconds / F.lit(60.0), 1)


def session_stats_cr(
    events: DataFrame,
    key: str = "cr_user_id",
    ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
    last_day: str | None = None,
) -> DataFrame:
    """Per user: sessions, events, total and mean session minutes.

    With ``last_day`` naming a date column, the latest such day comes along as
    last_event_date, in the same pass.
    """
    extra, merge, final = [], [], []
    if last_day:
        extra = [F.max(last_day).alias("last_event_date")]
        merge = final = [F.max("last_event_date").alias("last_event_date")]
    seconds = F.col("session_duration_sec")
    return session_durations(events, key, ts, gap, extra, merge).groupBy(key).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.sum("n_events").alias("engagement_event_count"),
        _minutes(F.sum(seconds)).alias("total_time_minutes"),
        _minutes(F.avg(seconds)).alias("avg_session_length_minutes"),
        *final,
    )


# --- sessions from days -----------------------------------------------------------------
#
# What a day of one user adds to the sessions of a history: its first and its last session
# as open edges, since the days next to it may go on with them, and totals of those in
# between, which nothing can change.  Days go together in any number and order.

_DAY_US = 86_400_000_000


def slice_day(column: str = "slice") -> Column:
    """Number of the UTC day that a slice begins in; events without a time share one far back."""
    return F.floor(F.col(column) / F.lit(_DAY_US)).cast("int")


def merge_slices(slices: DataFrame, key: str, last_day: str | None = None) -> DataFrame:
    """Fold rows of one (user, slice), as from different parts of a log."""
    return slices.groupBy(key, "slice").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n_events").alias("n_events"),
        *([F.max(last_day).alias(last_day)] if last_day else []),
    )


def day_sessions(slices: DataFrame, key: str, gap: int = config.SESSION_GAP_SECONDS, last_day: str | None = None) -> DataFrame:
    """One row per (user, day): `edges`, closed_sessions, closed_seconds, n_events."""
    days = slices.withColumn("day_no", slice_day())
    marked = session_slices(days, [key, "day_no"], gap)
    last = [F.max(last_day).alias(last_day)] if last_day else []
    sessions = marked.groupBy(key, "day_no", "session_id").agg(
        F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"), F.sum("n_events").alias("n_events"), *last
    )
    within = Window.partitionBy(key, "day_no")
    inner = (F.col("session_id") > 1) & (F.col("session_id") < F.max("session_id").over(within))
    seconds = whole_seconds(F.col("end_us"), F.col("start_us"))
    return sessions.withColumns({"inner": inner, "seconds": seconds}).groupBy(key, "day_no").agg(
        F.collect_list(F.when(~F.col("inner"), F.struct("start_us", "end_us"))).alias("edges"),
        F.count_if("inner").alias("closed_sessions"),
        F.coalesce(F.sum(F.when(F.col("inner"), F.col("seconds"))), F.lit(0)).alias("closed_seconds"),
        F.sum("n_events").alias("n_events"), *last,
    )


def stats_of_days(
    days: DataFrame, key: str, gap: int = config.SESSION_GAP_SECONDS, last_day: str | None = None
) -> DataFrame:
    """:func:`session_stats_cr` from :func:`day_sessions` rows, two edges a day at most."""
    edges = days.select(key, F.explode("edges").alias("edge")).select(
        key, F.coalesce("edge.start_us", F.lit(_NO_TIME)).alias("slice"),
        F.col("edge.start_us").alias("first_us"), F.col("edge.end_us").alias("last_us"),
    )
    open_sessions = session_slices(edges, key, gap).groupBy(key, "session_id").agg(
        whole_seconds(F.max("last_us"), F.min("first_us")).alias("seconds")
    )
    none = F.lit(0).cast("bigint")
    last = [F.lit(None).cast(days.schema[last_day].dataType).alias(last_day)] if last_day else []
    parts = open_sessions.select(
        key, F.lit(1).cast("bigint").alias("sessions"), F.when(F.col("seconds").isNull(), 0).otherwise(1).alias("timed"),
        F.coalesce("seconds", none).alias("seconds"), none.alias("n_events"), *last,
    ).unionByName(days.select(
        key, F.col("closed_sessions").alias("sessions"), F.col("closed_sessions").alias("timed"),
        F.col("closed_seconds").alias("seconds"), "n_events", *([last_day] if last_day else []),
    ))
    seconds, timed = F.sum("seconds"), F.sum("timed")
    return parts.groupBy(key).agg(
        F.sum("sessions").alias("session_count"),
        F.sum("n_events").alias("engagement_event_count"),
        _minutes(F.when(timed > 0, seconds)).alias("total_time_minutes"),
        _minutes(F.when(timed > 0, seconds / timed)).alias("avg_session_length_minutes"),
        *([F.max(last_day).alias("last_event_date")] if last_day else []),
    )


def session_stats_unity(
    events: DataFrame,
    key: str = "user_pseudo_id",
    ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
) -> DataFrame:
    """Per legacy user: session minutes; engagement_event_count counts *sessions* there."""
    return legacy_figures(session_stats_cr(events, key, ts, gap), key)


def legacy_figures(stats: DataFrame, key: str = "user_pseudo_id") -> DataFrame:
    """Session figures as the legacy apps name them."""
    return stats.select(
        key,
        F.col("session_count").alias("engagement_event_count"),
        "total_time_minutes",
        "avg_session_length_minutes",
    )
