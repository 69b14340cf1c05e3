"""Run-dated parquet snapshots, table rebuilds, CSV export and the load gate."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readtrail.functions.dates import export_day
from readtrail.session import remove_folder
from readtrail.sources.storage import files_below, newest_text, publish_text, size_below

_RUN = re.compile(r"run_date=\d{4}-\d{2}-\d{2}")
_MANIFESTS = "_manifests"


def stage(df: DataFrame, path: str | None) -> DataFrame:
    """Write a table that several branches of a job read, and read it back.

    The branches then scan a narrow file instead of each repeating the work up to
    here, and a lost executor costs a re-read.  ``path`` belongs in a folder that all
    executors share; without one the plan is returned as it is.
    """
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Run:
    """A published run of a table: what its manifest says."""

    base: str
    day: dt.date
    version: int
    folder: str  # of the data, below the day's folder
    schema: str  # as JSON
    files: int
    size: int
    metrics: dict[str, int | None]  # rows, and what else was counted while writing

    @property
    def rows(self) -> int:
        return self.metrics["rows"]

    @property
    def path(self) -> str:
        return f"{_day_folder(self.base, self.day)}/{self.folder}"

    def read(self, spark: SparkSession) -> DataFrame:
        """The run's rows; its schema is known, so no file is opened to find it."""
        return spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(self.path)


def _day_folder(base: str, day: dt.date) -> str:
    return f"{base}/run_date={day.isoformat()}"


def key_metrics(*keys: str) -> dict[str, Column]:
    """Counts of rows without a key, and estimates (to about 1 %) of distinct keys, for a run's manifest."""
    out = {}
    for key in keys:
        out[f"null_{key}"] = F.count_if(F.col(key).isNull())
        out[f"distinct_{key}"] = F.approx_count_distinct(key, 0.01)
    return out


def export_run(
    df: DataFrame, base: str, run_date: dt.date | None = None, metrics: dict[str, Column] | None = None,
    split_by: str | None = None,
) -> str:
    """Write a run of a table and publish it; gives the path of its rows.

    Rows go to a folder of their own in the day's folder, then a manifest is moved into
    place in one step.  A run that dies before that was never there, and the run it was to
    replace still is.  ``metrics`` are aggregates, counted in the writing pass itself.
    ``split_by`` puts the rows of each of a column's values in a folder of their own.
    """
    spark, day = df.sparkSession, run_date or export_day()
    folder = f"run-{uuid.uuid4().hex}"
    home = _day_folder(base, day)
    seen = Observation(folder)
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()])
    writer = observed.write.partitionBy(split_by) if split_by else observed.write
    writer.parquet(f"{home}/{folder}")
    files, size = size_below(spark, f"{home}/{folder}")
    manifest = {
        "folder": folder, "schema": df.schema.json(), "files": files, "size": size,
        "metrics": seen.get,
    }
    publish_text(spark, f"{home}/{_MANIFESTS}", json.dumps(manifest))
    return f"{home}/{folder}"


def published_runs(spark: SparkSession, base: str) -> Iterator[Run]:
    """Published runs, newest day first; of a day's runs the one published last.

    Lists folder names, and looks into one day at a time.
    """
    for name in sorted((f.name for f in files_below(spark, base) if _RUN.fullmatch(f.name)), reverse=True):
        version, text = newest_text(spark, f"{base}/{name}/{_MANIFESTS}")
        if text is not None:
            yield Run(base, dt.date.fromisoformat(name.removeprefix("run_date=")), version, **json.loads(text))


def newest_run(spark: SparkSession, base: str, before: dt.date | None = None) -> Run:
    """The newest published run, of the days before one day if that is given."""
    for run in published_runs(spark, base):
        if before is None or run.day < before:
            return run
    raise FileNotFoundError(f"no published run in run_date=YYYY-MM-DD folders under {base}")


def latest_run(spark: SparkSession, base: str) -> str:
    """Path of the newest published run; one whose files hold no rows counts too."""
    return newest_run(spark, base).path


def load_latest_run(spark: SparkSession, base: str) -> DataFrame:
    """Read the newest published run of a table and nothing of the older ones."""
    return newest_run(spark, base).read(spark)


def expire_runs(spark: SparkSession, base: str, keep_days: int) -> list[str]:
    """Delete all but the newest ``keep_days`` days of runs; gives the folders that went.

    Also goes what was never published, or was replaced, in the days that stay.  To be run
    when nothing writes or still reads those.
    """
    gone, kept = [], 0
    days = sorted((f.name for f in files_below(spark, base) if _RUN.fullmatch(f.name)), reverse=True)
    for name in days:
        _, text = newest_text(spark, f"{base}/{name}/{_MANIFESTS}")
        if text is None or kept == keep_days:
            gone.append(f"{base}/{name}")
            continue
        kept += 1
        current = json.loads(text)["folder"]
        gone += [f"{base}/{name}/{f.name}" for f in files_below(spark, f"{base}/{name}")
                 if f.name.startswith("run-") and f.name != current]
    for path in gone:
        remove_folder(spark, path)
    return gone


def check_runs(
    runs: dict[str, Run], keys: dict[str, str] | None = None,
    max_null_share: float = 1.0, max_duplicate_share: float = 1.0, min_rows: int = 1,
) -> None:
    """Raise if a run has too few rows, or too many without a key or with a key met before.

    ``keys`` names the key column of each table.  Reads the manifests only.
    """
    wrong = []
    for name, run in runs.items():
        if run.rows < min_rows:
            wrong.append(f"{name}: {run.rows} rows")
            continue
        key = (keys or {}).get(name)
        if key is None or not run.rows:
            continue
        nulls = run.metrics[f"null_{key}"]
        known = run.rows - nulls
        if nulls > max_null_share * run.rows:
            wrong.append(f"{name}: {nulls} of {run.rows} rows without {key}")
        if known - run.metrics[f"distinct_{key}"] > max_duplicate_share * known:
            wrong.append(f"{name}: about {known - run.metrics[f'distinct_{key}']} of {known} rows repeat a {key}")
    if wrong:
        raise ValueError(f"not fit to load: {'; '.join(wrong)}")


def save_table(df: DataFrame, name: str | None = None, path: str | None = None) -> None:
    """Rebuild a whole table, by catalog name or by path."""
    writer = df.write.mode("overwrite").format("parquet")
    if name is not None:
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        writer.save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a cohort or report as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def require_rows(**tables: DataFrame) -> None:
    """Raise if any table is empty; looks at one row of each."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"empty after loading: {', '.join(empty)}")
