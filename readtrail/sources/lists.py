"""Choice lists: languages, countries, app versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config


def language_list(languages: DataFrame) -> DataFrame:
    """Display languages without surrounding blanks; names are distinct before trimming."""
    return languages.select("display_language").distinct().select(
        F.trim("display_language").alias("display_language")
    )


def country_list(countries: DataFrame) -> DataFrame:
    return countries.select("country").orderBy(F.col("country").asc_nulls_first())


def _version_number(version: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: p.try_cast("int"))


def app_version_list(
    versions: DataFrame, at_least: str = config.MIN_APP_VERSION, numeric: bool = False
) -> DataFrame:
    """"All", then the versions from ``at_least`` up.

    Versions compare as text, so 'v1.0.100' comes before 'v1.0.25'; ``numeric=True``
    compares them part by part as numbers.
    """
    version = F.col("app_version")
    if numeric:
        recent = _version_number(version) >= _version_number(F.lit(at_least))
    else:
        recent = version >= at_least
    head = versions.sparkSession.range(1).select(F.lit("All").alias("app_version"))
    return head.union(versions.select("app_version").where(recent))
