from pyspark.sql import functions as F

from checks import adapters as A
from readtrail.plans.nightly import split_log
from readtrail.session import apply_settings


def test_no_stage_runs_in_methods_too_long_to_compile(spark):
    # HotSpot leaves methods of over 8,000 bytes to its interpreter
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    try:
        apply_settings(spark)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_log_split_is_the_same_in_short_methods(spark, raw_events, profile, tmp_path):
    log = raw_events(
        {"params": {"web_app_url": "https://play.example.org/?cr_lang=Zulu"}, "name": "app_launch", "app_id": profile.container_app_id},
        {"name": "level_completed", "params": {"level_number": 3, "number_of_successful_puzzles": 5}}, {"host": "other.example.org"},
        {"user": ""}, {"touch": None}, {"name": "other"}, {"params": {"page_location": None}},
    )
    found = []
    for limit in ("65535", "8000", "1"):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
        try:
            parts = split_log(log, profile, None, str(tmp_path / limit))
            found.append([sorted(map(str, p.collect())) for p in parts])
        finally:
            apply_settings(spark)
    assert found[0] == found[1] == found[2] and all(found[0])


def test_logs_are_dealt_while_their_rows_are_narrow(spark):
    events = spark.createDataFrame([(1, 2)], "event_id long, user_id long").withColumn("day", F.current_date())
    plan = A._dealt(events).select(F.struct("event_id", "user_id").alias("event_params"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and plan.index("event_params") < plan.index("RebalancePartitions")
