"""Shape the driver's tables like the logs and tables the library reads.

Only the registered queries use this; ``checks/oracle.py`` states the same rules
in SQL.  Residues of the event's ``k`` and the user's number decide which odd case a
row becomes: missing or empty ids, foreign hosts, unknown first touch, and so on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrail import AppProfile, schema
from readtrail.operators.cohorts import LearnerTables
from readtrail.plans.load_clean import load_clean, load_raw
from readtrail.plans.nightly import run_nightly
from readtrail.session import apply_settings, run_together, scratch_folder
from readtrail.sources.events import event_log, union_sources

PROFILE = AppProfile(
    web_host="game.example.org",
    standalone_suffix="_reader-standalone.example.net",
    container_app_id="org.example.container",
    legacy_marker="legacyreader",
)
AS_OF = dt.date(2024, 1, 28)
RUN_DATE = dt.date(2024, 1, 29)
NIGHTS = (dt.date(2024, 1, 10), dt.date(2024, 1, 20), dt.date(2024, 1, 29))
COHORT_RANGE = (dt.date(2024, 1, 3), dt.date(2024, 1, 26))
BITMAP_RANGES = (
    COHORT_RANGE, (dt.date(2024, 1, 10), dt.date(2024, 1, 17)), (dt.date(2021, 1, 1), dt.date(2024, 1, 31)),
)
COHORT_LANGUAGES = ["english", "french", "swahili", "zulu", None]
SPEND_SHIFT_DAYS = 9617  # 1998-01-01 becomes 2024-05-01
SPEND_RANGE = (dt.date(2024, 7, 1), dt.date(2026, 6, 30))
SEGMENT_RANGE = (dt.date(2021, 1, 1), dt.date(2027, 12, 31))
LANGUAGES = ["English", "French", "Swahili", "Zulu"]
DAY_US = 86_400_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n).cast("string") for n in names]), index.cast("int"))


def _param(key: str, text: Column | None = None, number: Column | None = None) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        F.struct(
            (F.lit(None) if text is None else text).cast("string").alias("string_value"),
            (F.lit(None) if number is None else number).cast("bigint").alias("int_value"),
        ).alias("value"),
    )


def _present(params: list[tuple[Column | None, Column]]) -> Column:
    """Array of the parameters whose condition holds."""
    kept = [p if cond is None else F.when(cond, p) for cond, p in params]
    return F.filter(F.array(*kept), lambda p: p.isNotNull())


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events with k, microseconds, day and learner."""
    base = _table(spark, sf_dir, "events").withColumns({
        "k": F.get_json_object("props", "$.k").cast("bigint"),
        "us": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"),
        "day": F.to_date("ts"),
    })
    base = base.withColumn("period", F.floor(F.unix_date("day") / 2))
    return base.withColumn("learner", F.concat_ws("-", "user_id", "period"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain events with the name of the user's nation."""
    nation = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("nation_no"), "n_name"
    )
    base = _dealt(plain_events(spark, sf_dir)).withColumn("nation_no", F.col("user_id") % 25)
    return base.join(nation, "nation_no", "left")


def _dealt(ev: DataFrame) -> DataFrame:
    """Events by day, dealt while they are narrow; a day that holds most of the log is split, small ones merge."""
    return ev.hint("rebalance", "day")


def _first_touch(days: Column) -> Column:
    user = F.col("user_id")
    return (
        F.when(user % 11 == 5, None)
        .when(user % 13 == 7, F.lit(18_627 * DAY_US))
        .otherwise(days * F.lit(DAY_US) + F.lit(3_600_000_000))
        .cast("bigint")
    )


def _log_row(
    ev: DataFrame, *, pseudo: Column, name: Column, touch: Column, params: Column,
    host: Column, app_id: Column, version: Column, country: Column,
) -> DataFrame:
    log = ev.select(
        pseudo.alias("user_pseudo_id"),
        name.alias("event_name"),
        F.date_format("day", "yyyyMMdd").alias("event_date"),
        F.col("us").alias("event_timestamp"),
        touch.alias("user_first_touch_timestamp"),
        params.alias("event_params"),
        F.struct(country.alias("country")).alias("geo"),
        F.struct(F.struct(host.alias("hostname")).alias("web_info")).alias("device"),
        F.struct(app_id.alias("id"), version.alias("version")).alias("app_info"),
    )
    assert log.columns == schema.EVENT_LOG.fieldNames()
    return log


def _game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log of the web game."""
    k, user = F.col("k"), F.col("user_id")
    kind = F.col("event_type")
    name = (
        F.when(k % 41 == 0, "screen_view")
        .when(kind == "error", "session_start")
        .when(kind == "signup", "download_completed")
        .when(kind == "view", "tapped_start")
        .when((kind == "click") & (k % 2 == 0), "selected_level")
        .when(kind == "click", "puzzle_completed")
        .when(kind == "purchase", "level_completed")
    )
    language = pick(LANGUAGES, (user + F.when(k % 8 == 0, 1).otherwise(0)) % 4)
    page = F.concat(
        F.when(k % 29 == 0, "http").otherwise("https"),
        F.lit(f"://{PROFILE.web_host}/index.html?x=1"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("&cr_lang="), language, F.lit("&v=2"))),
    )
    host = (
        F.when(k % 23 == 0, "elsewhere.example.org")
        .when(user % 5 == 0, PROFILE.bundled_host)
        .when(user % 5 == 1, f"demo{PROFILE.standalone_suffix}")
        .otherwise(PROFILE.web_host)
    )
    puzzles = F.floor("value").cast("bigint")
    params = _present([
        (None, _param("page_location", page)),
        (k % 37 != 0, _param("cr_user_id", F.when(k % 31 == 0, "").otherwise(F.col("learner")))),
        (k % 43 != 0, _param("level_number", number=k % 40)),
        (None, _param("number_of_successful_puzzles", number=puzzles)),
        (None, _param("success_or_failure", F.when(puzzles >= 3, "success").otherwise("failure"))),
    ])
    return _log_row(
        events(spark, sf_dir),
        pseudo=F.concat(F.when(k % 9 == 0, "q").otherwise("p"), F.col("learner")),
        name=name,
        touch=_first_touch(F.col("period") * 2 - user % 3),
        params=params,
        host=host,
        app_id=F.lit(None).cast("string"),
        version=F.lit(None).cast("string"),
        country=F.col("n_name"),
    )


def _launch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log of the container app; some learners occur in no game log."""
    k, user = F.col("k"), F.col("user_id")
    language = F.when(
        k < 20, pick(["english", "french", "swahili", None], k % 4)
    ).otherwise(pick(LANGUAGES, user % 4))
    url = F.concat(
        F.when(k % 27 == 0, "https://other.example.org").otherwise(f"https://{PROFILE.web_host}"),
        F.lit("/?s=1"),
        F.coalesce(F.concat(F.lit("&cr_lang="), language), F.lit("")),
    )
    learner = F.concat(F.col("learner"), F.when(k % 7 == 0, "x").otherwise(""))
    params = _present([
        (k % 37 != 0, _param("cr_user_id", F.when(k % 31 == 0, "").otherwise(learner))),
        (None, _param("web_app_url", url)),
    ])
    starts = F.col("event_type").isin("signup", "view") & (k % 13 != 0)
    return _log_row(
        events(spark, sf_dir),
        pseudo=F.concat(F.lit("p"), learner),
        name=F.when(starts, "app_launch").otherwise("app_open"),
        touch=_first_touch(F.col("period") * 2 - user % 3 - 1),
        params=params,
        host=F.lit(None).cast("string"),
        app_id=F.when(k % 19 == 0, "org.example.other").otherwise(PROFILE.container_app_id),
        version=F.lit(None).cast("string"),
        country=F.col("n_name"),
    )


def _legacy_log(spark: SparkSession, sf_dir: str, source: int) -> DataFrame:
    """Event log of the legacy apps, one of the three sources it is collected from."""
    k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")
    level = F.when(user % 3 == 0, k % 30 + 1).otherwise(k % 4 + 1)
    action = (
        F.when(kind == "purchase", F.concat(F.lit("LevelSuccess_"), level))
        .when(kind == "click", F.concat(F.lit("SegmentSuccess_"), k))
        .when(kind == "error", "Quit")
    )
    plain = kind.isin("signup", "view")
    params = _present([
        (~plain, _param("action", action)),
        (plain & (k % 19 != 0), _param("screen", F.lit("main"))),
        (plain & (k % 19 != 0), _param("engagement_ms", number=k)),
    ])
    ev = _dealt(plain_events(spark, sf_dir).where(user % 3 == source))
    country = F.concat(F.lit("NATION_"), (user + F.when(k % 10 == 0, 1).otherwise(0)) % 25)
    return _log_row(
        ev,
        pseudo=F.concat(F.lit("u"), user, F.lit("-"), F.floor(F.dayofmonth("day") / 3)),
        name=F.when(kind == "signup", "session_start").when(kind == "view", "user_engagement")
        .otherwise("GamePlay"),
        touch=_first_touch(F.unix_date("day") - user % 3),
        params=params,
        host=F.lit(None).cast("string"),
        app_id=F.when(user % 17 == 3, "org.example.other").otherwise(F.concat(
            F.lit("org.example.LegacyReader"),
            pick(["English", "French", "Swahili", ""], user % 4),
        )),
        version=F.concat(F.lit("1."), k % 5),
        country=country,
    )


_LOGS = {
    "game": _game_log,
    "launch": _launch_log,
    **{f"legacy-{n}": lambda spark, sf_dir, n=n: _legacy_log(spark, sf_dir, n) for n in range(3)},
}
_log_folders: dict[tuple[str, str, str], str] = {}


def _log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A log read back as nested parquet by event_date.

    It is written once per session and data folder, by whichever query needs it first.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _log_folders:
        folder = scratch_folder(spark, f"{name}-log")
        log = _LOGS[name](apply_settings(spark), sf_dir)
        log.write.partitionBy("event_date").parquet(folder)
        _log_folders[key] = folder
    return event_log(spark, _log_folders[key])


def build_logs(spark: SparkSession, sf_dir: str) -> None:
    """Write all logs, side by side."""
    run_together(*[lambda name=name: _log(spark, sf_dir, name) for name in _LOGS])


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "game")


def launch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "launch")


def legacy_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_log(spark, sf_dir, f"legacy-{n}") for n in range(3)]


def legacy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_sources(legacy_sources(spark, sf_dir))


def languages(spark: SparkSession) -> DataFrame:
    """Game length per language; English is listed twice."""
    return spark.sql("""
        SELECT * FROM VALUES
          ('english', 40L, 'English'), ('english', 40L, 'English (South Africa)'),
          ('french', 38L, 'French'), ('swahili', 36L, 'Swahili'), ('zulu', 0L, 'Zulu'),
          ('', 20L, 'Other')
        AS t(app_language, max_level, display_language)""")


def cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of learners: the customer's segment, and a pilot; some are in both."""
    learners = plain_events(spark, sf_dir).select("user_id", "learner").distinct()
    customer = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("cohort_name")
    )
    segment = learners.where(F.col("user_id") % 4 == 0).join(customer, "user_id")
    pilot = learners.where(F.col("user_id") % 6 == 0).withColumn("cohort_name", F.lit("pilot"))
    return segment.unionByName(pilot).select(
        F.col("learner").alias("cr_user_id"), "cohort_name"
    )


def display_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.upper("lang"), F.lit("  "))
    return _table(spark, sf_dir, "documents").select(text.alias("display_language"))


def app_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.lit("v1.0."), F.col("k"))
    return plain_events(spark, sf_dir).select(version.alias("app_version")).distinct()


# --- advertising ---------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").withColumns({
        "campaign_no": F.col("o_custkey") % 50,
        "day": F.date_add(F.to_date("o_orderdate"), SPEND_SHIFT_DAYS),
    })


def _campaign_name() -> Column:
    c = F.col("campaign_no")
    return (
        F.when(c % 10 == 0, "Brand awareness")
        .when(c % 10 == 5, "Ads: general")
        .otherwise(F.concat(
            F.lit("Ads: "), pick(LANGUAGES, c % 4), F.lit(" - NATION_"), c % 25,
            F.when(c % 3 == 0, " Campaign").otherwise(""),
        ))
    )


def google_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("o_orderstatus") != "F").select(
        F.col("campaign_no").alias("campaign_id"),
        F.col("day").alias("segments_date"),
        F.round(F.col("o_totalprice") * 1_000_000).cast("bigint").alias("metrics_cost_micros"),
    )


def google_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _orders(spark, sf_dir).groupBy("campaign_no").agg(
        F.min("day").alias("campaign_start_date"), F.max("day").alias("last_day")
    )
    return per.select(
        F.col("campaign_no").alias("campaign_id"),
        _campaign_name().alias("campaign_name"),
        "campaign_start_date",
        F.when(F.col("campaign_no") % 7 != 0, F.col("last_day")).alias("campaign_end_date"),
    )


def facebook_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("campaign_no")
    renamed = (c % 4 == 1) & (F.col("day") >= F.lit(dt.date(2026, 1, 1)))
    return _orders(spark, sf_dir).where(F.col("o_orderstatus") == "F").select(
        (c + 1000).alias("campaign_id"),
        F.col("day").alias("data_date_start"),
        F.when(renamed, "FB: Zulu - NATION_3 Campaign 2").otherwise(_campaign_name()).alias(
            "campaign_name"
        ),
        F.col("o_totalprice").alias("spend"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("day")).alias("start_time"),
        F.lit(None).cast("date").alias("end_time"),
    )


# --- built tables --------------------------------------------------------------

_raw: dict[tuple[str, str], tuple[str, LearnerTables]] = {}
_cleaned: dict[tuple[str, str], LearnerTables] = {}


def _nightly(spark: SparkSession, sf_dir: str) -> tuple[str, LearnerTables]:
    """Folder of the nightly job's runs, and the tables as it leaves them; built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _raw:
        base = scratch_folder(spark, "learner-tables")
        build_logs(spark, sf_dir)
        log = game_log(spark, sf_dir).unionByName(launch_log(spark, sf_dir))
        run_nightly(
            log, legacy_sources(spark, sf_dir), languages(spark), cohort_members(spark, sf_dir),
            PROFILE, None, base, AS_OF, RUN_DATE,
        )
        _raw[key] = base, load_raw(spark, base)
    return _raw[key]


def raw_tables(spark: SparkSession, sf_dir: str) -> LearnerTables:
    """Learner tables as the nightly job leaves them; nothing is cleaned for these."""
    return _nightly(spark, sf_dir)[1]


def tables(spark: SparkSession, sf_dir: str) -> LearnerTables:
    """Cleaned learner tables, written into the shared scratch folder once per session and data folder.

    The reports read those files, as they would on a cluster.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cleaned:
        base, _ = _nightly(spark, sf_dir)
        _cleaned[key] = load_clean(spark, base, staging=f"{base}/clean")
    return _cleaned[key]


def built_tables(spark: SparkSession, sf_dir: str) -> tuple[LearnerTables, LearnerTables]:
    """Learner tables as the nightly job leaves them, and cleaned."""
    return raw_tables(spark, sf_dir), tables(spark, sf_dir)
