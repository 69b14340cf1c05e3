"""Sessions of a file stream against the batch over the same rows."""

import random

import pytest
from conftest import rows

from readtrail.operators.activity import session_durations
from readtrail.streaming import sessions as S

SCHEMA = "user string, event_timestamp bigint"
SECOND = 1_000_000


def columns(df):
    return rows(df, "user", "session_id", "n_events", "session_duration_sec")


def batches(seed, n=4):
    """Events of consecutive hours; users share times, some have no time, one has no name."""
    r = random.Random(seed)
    return [
        [(r.choice(["a", "b", None]), None if r.random() < 0.03 else (hour * 3600 + r.randrange(3600)) * SECOND + r.randrange(SECOND))
         for _ in range(120)]
        for hour in range(n)
    ]


class Run:
    def __init__(self, spark, tmp_path):
        self.spark, self.log = spark, str(tmp_path / "log")
        self.out, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def arrive(self, rows_):
        self.spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(self.log)

    def take(self, delay="1 hour", key="user"):
        return S.take_available(S.event_stream(self.spark, self.log, SCHEMA), key, self.out, self.checkpoint, delay)

    def result(self):
        return S.streamed_durations(self.spark, self.out, self.checkpoint, "user")


@pytest.fixture
def stream(spark, tmp_path):
    return Run(spark, tmp_path)


def test_equal_to_the_batch(spark, stream):
    seen = []
    for part in batches(1):
        stream.arrive(part)
        seen += part
        report = stream.take()
        assert report.rows >= len(part) and report.late_rows == 0
        want = session_durations(spark.createDataFrame(seen, SCHEMA), "user")
        assert columns(stream.result()) == columns(want)
    # most sessions are closed and written by now, only late ones are still state
    assert S.finished_sessions(spark, stream.out, "user", "string").count() > 20
    assert 0 < S.open_sessions(spark, stream.checkpoint, "user").count() < 60


def test_the_gap_is_in_whole_seconds(spark, stream):
    t = [0, 121 * SECOND - 1, 242 * SECOND - 1, 242 * SECOND - 1 + 120 * SECOND]
    stream.arrive([("a", x) for x in t])
    stream.take()
    # 120.999999 s is within the gap of 120 whole seconds, 121 s is not
    assert columns(stream.result()) == [("a", 1, 2, 120), ("a", 2, 2, 120)]
    assert columns(session_durations(spark.createDataFrame([("a", x) for x in t], SCHEMA), "user")) == columns(stream.result())


def test_late_rows_within_the_delay_join_their_session(stream):
    stream.arrive([("a", 0), ("a", 200 * SECOND), ("b", 3000 * SECOND)])
    stream.take()
    stream.arrive([("a", 100 * SECOND)])  # 2,900 s late; joins the two sessions of a
    assert stream.take().late_rows == 0
    assert columns(stream.result()) == [("a", 1, 3, 200), ("b", 1, 1, 0)]


def test_rows_behind_the_watermark_are_left_out_and_counted(stream):
    stream.arrive([("a", 0), ("b", 9000 * SECOND)])
    stream.take()
    stream.arrive([("c", 10_000 * SECOND)])
    stream.take()
    stream.arrive([("a", 50 * SECOND), ("c", 10_010 * SECOND)])
    assert stream.take().late_rows == 1
    assert columns(stream.result()) == [("a", 1, 1, 0), ("b", 1, 1, 0), ("c", 1, 2, 10)]


def test_a_run_without_new_files_changes_nothing(stream):
    stream.arrive([("a", 0), (None, 5 * SECOND), ("a", None), ("a", None)])
    stream.take()
    first = columns(stream.result())
    assert first == [("a", 1, 2, None), ("a", 2, 1, 0), (None, 1, 1, 0)]
    assert stream.take().rows == 0
    assert columns(stream.result()) == first
