"""Sessions of a live event log, by Structured Streaming.

A stream groups timed events by user and session window.  A session is finished, and
written once, when the watermark has passed its end: ``delay`` behind the newest event time
seen.  State holds open sessions only, one row each, so it is bounded by the users active
within the delay, not by the log.

*Late rows.*  A row behind the watermark is left out of the stream's sessions, and counted
(``late_rows`` of :class:`StreamReport`; Spark counts them after combining rows of one session
and task).  The nightly build takes late rows by any time, so the day's tables hold them.

*Rows without a time* are one session per user, as in the batch; they are no business of a
watermark and go to a table of counts beside.

The number of shuffle partitions is part of a checkpoint: it stays what it was at the first start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from readtrail import config
from readtrail.functions.dates import whole_seconds
from readtrail.session import run_together
from readtrail.sources.storage import files_below

_TIMED, _UNTIMED = "sessions", "untimed"


@dataclass(frozen=True)
class StreamReport:
    """What the batches of one run of the stream took in."""

    batches: int
    rows: int
    late_rows: int


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """Event files as they arrive in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def session_windows(
    events: DataFrame, key: str, delay: str = "1 hour", ts: str = "event_timestamp", gap: int = config.SESSION_GAP_SECONDS
) -> DataFrame:
    """Sessions of a stream: the key, start_us, end_us and n_events.

    Two events share a session if fewer than ``gap + 1`` seconds lie between them, which is
    ``gap`` whole seconds; windows that touch are joined, hence the microsecond less.
    """
    window = F.session_window("_at", f"{(gap + 1) * 1_000_000 - 1} microseconds")
    timed = events.where(F.col(ts).isNotNull()).select(key, ts, F.timestamp_micros(ts).alias("_at"))
    return (
        timed.withWatermark("_at", delay).groupBy(key, window)
        .agg(F.min(ts).alias("start_us"), F.max(ts).alias("end_us"), F.count(F.lit(1)).alias("n_events"))
        .select(key, "start_us", "end_us", "n_events")
    )


def _start(rows: DataFrame, out: str, checkpoint: str, name: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").start()
    )


def _ended(query: StreamingQuery) -> StreamReport:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    batches = query.recentProgress
    return StreamReport(
        len(batches), sum(b.numInputRows for b in batches),
        sum(s.numRowsDroppedByWatermark for b in batches for s in b.stateOperators),
    )


def take_available(
    events: DataFrame, key: str, out: str, checkpoint: str, delay: str = "1 hour", ts: str = "event_timestamp",
    gap: int = config.SESSION_GAP_SECONDS,
) -> StreamReport:
    """Take in what has arrived since the last run, and end.

    Each file is taken once, also when a run dies and is started again: offsets and state are
    in ``checkpoint``, and of ``out`` only committed files are read.
    """
    untimed = events.where(F.col(ts).isNull()).select(key)
    queries = (
        _start(session_windows(events, key, delay, ts, gap), out, checkpoint, _TIMED),
        _start(untimed, out, checkpoint, _UNTIMED),
    )
    return run_together(*[lambda q=q: _ended(q) for q in queries])[0]


def finished_sessions(spark: SparkSession, out: str, key: str, key_type: str) -> DataFrame:
    """Sessions that the stream has closed: the key, start_us, end_us, n_events."""
    schema = f"`{key}` {key_type}, start_us bigint, end_us bigint, n_events bigint"
    if not files_below(spark, f"{out}/{_TIMED}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/{_TIMED}")


def open_sessions(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Sessions that are not closed yet, as the stream's state holds them after its last batch."""
    state = spark.read.format("statestore").load(f"{checkpoint}/{_TIMED}")
    # the state row is the key, the window, and the three aggregates in their order
    names = state.schema["value"].dataType.names
    low, high, n = names[-3:]
    return state.select(
        F.col(f"key.{key}").alias(key), F.col(f"value.{low}").alias("start_us"),
        F.col(f"value.{high}").alias("end_us"), F.col(f"value.{n}").alias("n_events"),
    )


def streamed_durations(spark: SparkSession, out: str, checkpoint: str, key: str, key_type: str = "string") -> DataFrame:
    """:func:`~readtrail.operators.activity.session_durations` of everything taken in so far.

    Sessions are numbered per user in order of time; a user's rows without a time come first.
    """
    closed = finished_sessions(spark, out, key, key_type)
    parts = closed.unionByName(open_sessions(spark, checkpoint, key))
    if files_below(spark, f"{out}/{_UNTIMED}"):
        untimed = spark.read.schema(f"`{key}` {key_type}").parquet(f"{out}/{_UNTIMED}")
        none = F.lit(None).cast("bigint")
        parts = parts.unionByName(
            untimed.groupBy(key).agg(F.count(F.lit(1)).alias("n_events")).select(key, none.alias("start_us"), none.alias("end_us"), "n_events")
        )
    in_order = Window.partitionBy(key).orderBy(F.col("start_us").asc_nulls_first())
    return parts.select(
        key, F.row_number().over(in_order).cast("bigint").alias("session_id"), "n_events",
        whole_seconds(F.col("end_us"), F.col("start_us")).alias("session_duration_sec"),
    )
