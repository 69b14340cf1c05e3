"""Matches on stored tables: same rows, and nothing moves."""

import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readtrail.operators import matching
from readtrail.operators.cleaning import best_row_cr
from readtrail.sources.colocated import save_by_key, without_layout


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, tmp_path):
    names = []

    def save(df, key="id"):
        names.append(f"stored_{uuid.uuid4().hex}")
        return save_by_key(df, key, names[-1], 4, str(tmp_path / names[-1]))

    yield save
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_move_nothing_and_give_the_same(spark, stored, no_broadcast):
    left = spark.createDataFrame([(f"k{i % 37}" if i % 11 else None, i) for i in range(300)], "id string, n int")
    right = spark.createDataFrame([(f"k{i}" if i % 9 else None, -i) for i in range(0, 60, 3)], "id string, n int").dropDuplicates(["id"])
    a, b = stored(left), stored(right)
    for match in (matching.semi_join, matching.anti_join):
        got = match(a, b, "id")
        assert rows(without_layout(got, "id")) == rows(match(left, right, "id"))
        assert "Exchange" not in plan_of(got)
    for more in ({}, {"unmatched_null": True}, {"when": F.col("n") > 100}):
        got = matching.keyed_update(a, b, "id", "n", **more)
        assert rows(without_layout(got, "id")) == rows(matching.keyed_update(left, right, "id", "n", **more))
        assert "Exchange" not in plan_of(got)
    got = matching.mark_duplicates(a, "id")
    assert rows(without_layout(got, "id")) == rows(matching.mark_duplicates(left, "id"))
    assert "Exchange" not in plan_of(got)


def test_one_row_per_learner_moves_nothing(spark, stored, no_broadcast):
    table = spark.createDataFrame(
        [(f"u{i % 20}" if i % 7 else None, "CR", ["Kenya", "Mali"][i % 2], "english", i % 30, ["level_completed", None][i % 2], i)
         for i in range(200)],
        "cr_user_id string, app string, country string, app_language string, max_user_level int, furthest_event string, engagement_event_count int",
    )
    kept = stored(table, "cr_user_id")
    got = best_row_cr(kept)
    assert rows(without_layout(got, "cr_user_id")) == rows(best_row_cr(table))
    assert "Exchange" not in plan_of(got)


def test_a_table_is_rebuilt_with_one_file_a_bucket(spark, stored, tmp_path):
    table = stored(spark.range(1000).selectExpr("CAST(id AS string) AS id"))
    files = {r[0] for r in table.select(F.input_file_name()).collect()}
    assert len(files) == 4 and table.count() == 1000
    assert table.columns == ["id", "id__key", "id__null"]
