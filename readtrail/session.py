"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

# settings the jobs rely on, for skewed keys and long expressions; a cluster keeps its own partition counts
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even if a later step then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot compiles no method of over 8,000 bytes: a stage that generates one would be
    # interpreted row by row, so it runs operator by operator, in short methods, instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """New folder path for intermediate tables, in the cluster's shared folder.

    That is what spark.checkpoint.dir names.  A session without it gets a local temporary
    folder if it runs on one machine, and an error if it does not: executors would not see
    each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if re.fullmatch(r"local(\[.*\])?", master) is None:
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder (master {master!r})")
        base = tempfile.mkdtemp(prefix="readtrail-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, on whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run_together(*jobs: Callable[[], T]) -> list[T]:
    """Submit independent Spark jobs at once, so one fills the gaps of another."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
