import datetime as dt
import re
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readtrail import schema
from readtrail.functions.params import param_str
from readtrail.operators import launches
from readtrail.plans.load_clean import load_clean
from readtrail.plans.nightly import run_nightly
from readtrail.session import scratch_folder
from readtrail.sources import lists, snapshots
from readtrail.sources.events import event_log

D = dt.date
AS_OF = D(2024, 6, 1)


def test_event_log_prunes_days(spark, raw_events, tmp_path):
    days = [f"2024-01-{n:02} 10:00:00" for n in (9, 10, 11, 12)]
    raw_events(*[{"at": d} for d in days]).write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    df = event_log(spark, str(tmp_path / "log"), D(2024, 1, 10), D(2024, 1, 11))
    assert rows(df.select("event_date")) == [("20240110",), ("20240111",)]
    files = {r[0] for r in df.select(F.input_file_name()).collect()}
    assert len(files) == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]*>= 20240110", plan)
    assert event_log(spark, str(tmp_path / "log")).count() == 4


def test_event_log_reads_only_declared_fields(spark, raw_events, tmp_path):
    """A full log has more value types and columns; the scan leaves them alone."""
    wide = raw_events({}).withColumn("extra", F.lit(1)).withColumn(
        "event_params",
        F.transform("event_params", lambda p: F.struct(
            p["key"].alias("key"),
            F.struct(F.lit(1.5).alias("double_value"), p["value"]["string_value"].alias("string_value"),
                     p["value"]["int_value"].alias("int_value")).alias("value"),
        )),
    )
    wide.write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    df = event_log(spark, str(tmp_path / "log"))
    assert df.schema["event_params"].dataType == schema.EVENT_LOG["event_params"].dataType
    assert "double_value" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.select(param_str("cr_user_id")).first()[0] == "u1"


def test_latest_run(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.load_latest_run(spark, base)
    for day, n in ((D(2024, 2, 9), 3), (D(2024, 2, 10), 5)):
        snapshots.export_run(spark.range(n), base, day)
    assert snapshots.load_latest_run(spark, base).count() == 5
    assert snapshots.load_latest_run(spark, base).columns == ["id"]
    # exporting again replaces that day's run
    snapshots.export_run(spark.range(2), base, D(2024, 2, 10))
    assert snapshots.load_latest_run(spark, base).count() == 2
    # a newest run without rows is still the newest
    snapshots.export_run(spark.range(0), base, D(2024, 2, 11))
    with pytest.raises(ValueError, match="progress"):
        snapshots.require_rows(progress=snapshots.load_latest_run(spark, base), other=spark.range(1))


def test_latest_run_needs_a_dated_folder(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t" / "run_date=tomorrow"))
    with pytest.raises(FileNotFoundError):
        snapshots.load_latest_run(spark, str(tmp_path / "t"))


def test_a_run_that_dies_was_never_there(spark, tmp_path):
    base = str(tmp_path / "t")
    day = D(2024, 2, 9)
    snapshots.export_run(spark.range(3), base, day)
    fails = spark.range(0, 1000, 1, 8).withColumn(
        "id", F.when(F.col("id") == 999, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id"))
    )
    for when in (day, D(2024, 2, 10)):  # the same day again, and a new one
        with pytest.raises(Exception, match="killed"):
            snapshots.export_run(fails, base, when)
    # as a killed driver leaves it: all parts there, nothing published
    spark.range(7).write.parquet(f"{base}/run_date=2024-02-11/run-half")
    assert [(r.day, r.rows) for r in snapshots.published_runs(spark, base)] == [(day, 3)]
    assert rows(snapshots.load_latest_run(spark, base)) == [(0,), (1,), (2,)]
    snapshots.export_run(spark.range(2), base, day)
    newest = snapshots.newest_run(spark, base)
    assert (newest.version, newest.rows, newest.files > 0, newest.size > 0) == (2, 2, True, True)
    gone = snapshots.expire_runs(spark, base, 1)
    assert snapshots.load_latest_run(spark, base).count() == 2
    assert {p.removeprefix(base)[:20] for p in gone} >= {"/run_date=2024-02-10"[:20], "/run_date=2024-02-11"[:20]}
    left = [p.name for p in (tmp_path / "t" / "run_date=2024-02-09").iterdir() if p.name.startswith("run-")]
    assert left == [newest.folder]


def test_the_gate_reads_what_was_counted_while_writing(spark, tmp_path):
    base = str(tmp_path / "t")
    table = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    snapshots.export_run(table, base, D(2024, 2, 9), snapshots.key_metrics("k"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    run = snapshots.newest_run(spark, base)
    assert run.metrics == {"rows": 4, "null_k": 1, "distinct_k": 2}
    runs, keys = {"t": run}, {"t": "k"}
    snapshots.check_runs(runs, keys, max_null_share=0.25, max_duplicate_share=0.34)
    for limits, text in (({"max_null_share": 0.2}, "without k"), ({"max_duplicate_share": 0.3}, "repeat a k"), ({"min_rows": 5}, "4 rows")):
        with pytest.raises(ValueError, match=text):
            snapshots.check_runs(runs, keys, **limits)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert run.read(spark).schema == table.schema
    # plans that fold to nothing are counted as well
    snapshots.export_run(table.where("false"), base, D(2024, 2, 10), snapshots.key_metrics("k"))
    assert snapshots.newest_run(spark, base).metrics == {"rows": 0, "null_k": 0, "distinct_k": 0}


def test_two_writers_get_two_versions(spark, tmp_path):
    from readtrail.session import run_together
    from readtrail.sources.storage import newest_text, publish_text

    folder = str(tmp_path / "m")
    got = run_together(*[lambda n=n: publish_text(spark, folder, f"text {n}") for n in range(6)])
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert newest_text(spark, folder) == (6, f"text {got.index(6)}")


def test_csv_has_a_header_and_no_index(spark, tmp_path):
    snapshots.export_csv(spark.range(2).withColumn("name", F.lit("a,b")), str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert rows(back) == [("0", "a,b"), ("1", "a,b")]
    assert back.columns == ["id", "name"]


def test_save_table_rebuilds(spark, tmp_path):
    path = str(tmp_path / "saved")
    for n in (5, 2):
        snapshots.save_table(spark.range(n), path=path)
    assert spark.read.parquet(path).count() == 2
    for n in (5, 2):
        snapshots.save_table(spark.range(n), name="rebuilt", path=str(tmp_path / "rebuilt"))
    assert spark.table("rebuilt").count() == 2
    spark.sql("DROP TABLE rebuilt")


def test_scratch_folder_is_the_shared_one(spark):
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf.get(name, default)))

    shared = session(**{"spark.checkpoint.dir": "hdfs://shared/dir/"})
    assert scratch_folder(shared, "x").startswith("hdfs://shared/dir/x-")
    assert "readtrail-" in scratch_folder(session(**{"spark.master": "local[4]"}), "x")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(RuntimeError):
            scratch_folder(session(**{"spark.master": master}), "x")
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")


def test_lists(spark):
    names = spark.createDataFrame([(" English ",), ("English",), ("English",), (None,)], "display_language string")
    # distinct comes before trimming
    assert rows(lists.language_list(names)) == [("English",), ("English",), (None,)]
    versions = spark.createDataFrame([("v1.0.9",), ("v1.0.24",), ("v1.0.25",), ("v1.0.100",), ("v1.0.25",)],
                                     "app_version string")
    assert [r[0] for r in lists.app_version_list(versions).collect()][0] == "All"
    assert rows(lists.app_version_list(versions)) == [("All",), ("v1.0.25",), ("v1.0.25",), ("v1.0.9",)]
    assert rows(lists.app_version_list(versions, numeric=True)) == [
        ("All",), ("v1.0.100",), ("v1.0.25",), ("v1.0.25",)]
    a = spark.createDataFrame([("Kenya",), (None,), ("Kenya",)], "country string")
    b = spark.createDataFrame([("Ghana",), (None,)], "country string")
    countries = launches.active_countries(a, b)
    assert [r[0] for r in lists.country_list(countries).collect()] == [None, "Ghana", "Kenya"]


def launch(**more):
    url = more.pop("url", "https://play.example.org/?cr_lang=Zulu")
    return {"name": "app_launch", "app_id": "org.example.shell", "host": None,
            "params": {"web_app_url": url}, **more}


def test_launches(spark, raw_events, profile):
    log = raw_events(
        launch(user="twice", at="2024-01-10 12:00:00", touch="2024-01-09"),
        launch(user="twice", at="2024-01-10 11:00:00", touch="2024-01-09"),
        launch(user="", touch="2024-01-09"),
        launch(user=None), launch(user="no-touch", touch=None), launch(user="old", touch="2020-12-31"),
        launch(user="other-app", app_id="org.example.other"),
        launch(user="other-url", url="https://elsewhere.example.org/?cr_lang=zulu"),
        launch(user="other-event", name="app_open"),
        launch(user="no-language", url="https://play.example.org/?x=1"),
    )
    cohorts = spark.createDataFrame([("twice", "A"), ("twice", "B"), ("nobody", "C")], schema.COHORTS)
    table = launches.app_launch(log, cohorts, profile, AS_OF)
    assert rows(table, "cr_user_id", "app_language", "first_open", "cohort_name") == [
        ("", "zulu", D(2024, 1, 9), None), ("no-language", None, D(2024, 1, 10), None),
        ("twice", "zulu", D(2024, 1, 9), "A"), ("twice", "zulu", D(2024, 1, 9), "B"),
    ]
    first = table.where("cr_user_id = 'twice'").select(F.unix_micros("first_launch_ts")).first()[0]
    assert first == log.where("event_timestamp IS NOT NULL").agg(F.min("event_timestamp")).first()[0]


def test_nightly_then_load(spark, raw_events, languages, profile, tmp_path):
    log = raw_events(
        {"user": "a", "name": "level_completed", "params": {"level_number": 2, "number_of_successful_puzzles": 4}},
        launch(user="a", touch="2024-01-05", params={"web_app_url": "https://play.example.org/?cr_lang=ukranian"}),
    )
    old = raw_events({"name": "GamePlay", "app_id": "org.example.OldReaderFrench", "params": {"action": "LevelSuccess_2"}})
    cohorts = spark.createDataFrame([("a", "A")], schema.COHORTS)
    base = str(tmp_path / "tables")
    paths = run_nightly(log, [old, old], languages, cohorts, profile, str(tmp_path / "staging"), base,
                        AS_OF, D(2024, 5, 31))
    assert sorted(paths) == ["cr_app_launch", "cr_user_progress", "unity_user_progress"]
    tables = load_clean(spark, base)
    assert rows(tables.progress, "cr_user_id", "max_user_level", "first_open") == [("a", 3, D(2024, 1, 5))]
    assert rows(tables.legacy, "max_user_level", "level_completed_count") == [(2, 2)]
    assert rows(tables.launches, "cr_user_id", "app_language", "cohort_name") == [("a", "english", "A")]
    run_nightly(log.where("false"), [old], languages, cohorts, profile, str(tmp_path / "s2"), base,
                AS_OF, D(2024, 6, 1))
    with pytest.raises(ValueError, match="cr_user_progress: 0 rows; cr_app_launch: 0 rows"):
        load_clean(spark, base)
