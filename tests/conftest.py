import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from readtrail import AppProfile, schema  # noqa: E402
from readtrail.session import apply_settings  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("readtrail-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield apply_settings(session)
    session.stop()


@pytest.fixture(scope="session")
def profile():
    return AppProfile(
        web_host="play.example.org",
        standalone_suffix="_kids-standalone.example.net",
        container_app_id="org.example.shell",
        legacy_marker="OldReader",
    )


def micros(text: str) -> int:
    moment = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
    return round(moment.timestamp() * 1_000_000)


_AUTO = object()


@pytest.fixture(scope="session")
def raw_events(spark):
    """Build an event log from short dicts; every field has a usable default."""

    def build(*rows):
        out = []
        for row in rows:
            r = {"at": "2024-01-10 12:00:00", "user": "u1", "name": "session_start", "touch": _AUTO,
                 "country": "Kenya", "host": "play.example.org", "app_id": None, "version": None,
                 "device": "d1", "params": {}, "date": None, "no_params": False}
            r.update(row)
            params = {"page_location": "https://play.example.org/?cr_lang=English", **r["params"]}
            if r["user"] is not None:
                params.setdefault("cr_user_id", r["user"])
            if r["no_params"]:
                params = {}
            entries = [
                (k, (v, None) if isinstance(v, str) or v is None else (None, v))
                for k, v in params.items()
            ]
            touch = r["at"][:10] if r["touch"] is _AUTO else r["touch"]
            out.append((
                r["device"], r["name"], r["date"] or r["at"][:10].replace("-", ""), micros(r["at"]),
                None if touch is None else micros(touch), entries, (r["country"],),
                ((r["host"],),), (r["app_id"], r["version"]),
            ))
        return spark.createDataFrame(out, schema.EVENT_LOG)

    return build


@pytest.fixture(scope="session")
def languages(spark):
    return spark.createDataFrame(
        [("english", 40, "English"), ("english", 40, "English (ZA)"), ("french", 30, "French"),
         ("zulu", 0, "Zulu")],
        schema.LANGUAGE_MAX_LEVEL,
    )


def rows(df, *columns):
    """Rows as tuples, sorted, of the given columns."""
    out = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in out), key=lambda r: tuple((v is None, str(v)) for v in r))
