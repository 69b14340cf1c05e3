"""Every registered query against its SQL twin, and what its plan may not contain."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import oracle, registry

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Pandas"):
        assert word not in plan
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(text(v) for v in row) for row in result.fetchall())
    got = sorted(tuple(text(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_progress_invariants(spark):
    from checks import adapters
    from pyspark.sql import functions as F

    progress = adapters.raw_tables(spark, SF_DIR).progress
    wrong = progress.where(
        (F.col("la_flag") != F.when(F.col("max_user_level") >= 1, 1).otherwise(0))
        | (F.col("ra_flag") != F.when(F.col("max_user_level") >= 25, 1).otherwise(0))
        | (F.col("ra_date") < F.col("la_date"))
        | (F.col("la_date").isNull() != (F.col("max_user_level") == 0))
    )
    assert wrong.count() == 0
    clean = adapters.tables(spark, SF_DIR)
    for df in (clean.progress, clean.launches):
        assert df.count() == df.select("cr_user_id").distinct().count()


def test_raw_tables_are_not_cleaned(spark, tmp_path, monkeypatch):
    """A query on the nightly tables alone does not pay for the cleaned ones."""
    from checks import adapters

    runs = []
    monkeypatch.setattr(adapters, "_raw", {}, raising=False)
    monkeypatch.setattr(adapters, "_cleaned", {}, raising=False)
    monkeypatch.setattr(adapters, "_built", {}, raising=False)
    monkeypatch.setattr(adapters, "load_clean", lambda *args, **more: runs.append(more) or "clean")
    assert QUERIES["milestone_flags"](spark, SF_DIR).count() and QUERIES["active_countries"](spark, SF_DIR).count()
    assert runs == []
    assert adapters.tables(spark, SF_DIR) == adapters.tables(spark, SF_DIR) == "clean"
    assert len(runs) == 1
