"""Small files on whatever store the tables lie in, through the session's own file systems."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_VERSION = re.compile(r"(\d{8})\.json")


@dataclass(frozen=True)
class Entry:
    name: str
    size: int


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_below(spark: SparkSession, folder: str) -> list[Entry]:
    """Files and folders directly below a folder; none if it is not there."""
    files, at = _files(spark, folder), _path(spark, folder)
    if not files.exists(at):
        return []
    return [Entry(f.getPath().getName(), f.getLen()) for f in files.listStatus(at)]


def size_below(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number and bytes of the parquet files of a written table, its split folders included."""
    files, size, found = _files(spark, folder), 0, 0
    listed = files.listFiles(_path(spark, folder), True)
    while listed.hasNext():
        file = listed.next()
        if file.getPath().getName().endswith(".parquet"):
            found, size = found + 1, size + file.getLen()
    return found, size


def _versions(spark: SparkSession, folder: str) -> list[int]:
    found = (_VERSION.fullmatch(f.name) for f in files_below(spark, folder))
    return sorted(int(m[1]) for m in found if m)


def publish_text(spark: SparkSession, folder: str, text: str) -> int:
    """Write the next version of a small text; readers see all of it or nothing.

    It is written under another name first and then renamed, and a rename never replaces:
    of two writers at once, the second gets the next number.
    """
    jvm, files = spark.sparkContext._jvm, _files(spark, folder)
    files.mkdirs(_path(spark, folder))
    draft = _path(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    version = max(_versions(spark, folder), default=0) + 1
    while True:
        try:
            context.rename(draft, _path(spark, f"{folder}/{version:08}.json"), no_options)
            return version
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            version += 1


def newest_text(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The newest version of a published text, and its number; (0, None) without any."""
    versions = _versions(spark, folder)
    if not versions:
        return 0, None
    source = _files(spark, folder).open(_path(spark, f"{folder}/{versions[-1]:08}.json"))
    try:
        return versions[-1], spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
