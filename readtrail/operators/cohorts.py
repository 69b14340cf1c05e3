"""Choosing the learner table of an app and filtering a cohort from it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config


@dataclass(frozen=True)
class LearnerTables:
    """The cleaned learner tables."""

    progress: DataFrame
    legacy: DataFrame
    launches: DataFrame


@dataclass(frozen=True)
class CohortFilter:
    """First-open range (inclusive), languages and countries; None or "All" keep all."""

    daterange: tuple[dt.date, dt.date] | None = None
    languages: list[str | None] | str | None = None
    countries: list[str | None] | str | None = None


def as_list(value: list | tuple | str | None) -> list:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def app_name(app: list[str] | str | None) -> str:
    names = as_list(app)
    return str(names[0]) if names else ""


def _one_of(column: str, values: list[str | None] | str | None) -> Column | None:
    """Membership test, None when nothing is to be filtered; None in a list matches NULL."""
    wanted = as_list(values)
    if not wanted or wanted == ["All"]:
        return None
    test = F.col(column).isin([v for v in wanted if v is not None])
    return test | F.col(column).isNull() if None in wanted else test


@dataclass(frozen=True)
class AppKind:
    """What sets a kind of app apart: its learner table, whether rows name the app, its funnel's size."""

    table: str
    by_app: bool
    funnel: str


# a choice of several apps is of the first of these kinds that it holds
APP_KINDS = {
    "legacy": AppKind("legacy", by_app=False, funnel="compact"),
    "standalone": AppKind("progress", by_app=True, funnel="compact"),
    "all": AppKind("progress", by_app=False, funnel="compact"),
    "web": AppKind("progress", by_app=False, funnel="large"),
}
_KIND_OF_NAME = {"Unity": "legacy", "All": "all"}
WEB_APP = "CR"


def app_kind(app: list[str] | str | None) -> AppKind:
    """Kind of an app, or of a choice of apps; standalone builds are known by their name's end."""
    kinds = {
        _KIND_OF_NAME.get(name, "standalone" if name.lower().endswith("standalone") else "web")
        for name in filter(None, as_list(app))
    }
    if kinds == {"all", "standalone"}:
        kinds = {"all"}  # all builds: nothing to tell apart
    return APP_KINDS[next((k for k in APP_KINDS if k in kinds), "web")]


def select_users(tables: LearnerTables, app: list[str] | str, stat: str | None = None) -> DataFrame:
    """Learner table that a figure of an app is read from; learners reached by the web app are launches."""
    if stat == "LR" and as_list(app) == [WEB_APP]:
        return tables.launches
    kind = app_kind(app)
    users = getattr(tables, kind.table)
    return users.where(F.col("app").isin(as_list(app))) if kind.by_app else users


def cohort(
    df: DataFrame, filters: CohortFilter = CohortFilter(), app: list[str] | str | None = None
) -> DataFrame:
    """Rows of a learner table inside the filters."""
    language = "app_language" if "app_language" in df.columns else "language"
    tests = [_one_of("country", filters.countries), _one_of(language, filters.languages)]
    if "app" in df.columns:
        tests.append(_one_of("app", app))
    if filters.daterange is not None:
        start, end = filters.daterange
        tests.append(F.col("first_open").between(F.lit(start), F.lit(end)))
    return reduce(DataFrame.where, [t for t in tests if t is not None], df)


def filtered_cohort(
    tables: LearnerTables, app: list[str] | str, filters: CohortFilter = CohortFilter()
) -> tuple[DataFrame, DataFrame | None]:
    """Progress cohort of an app and, for CR alone, its launch cohort."""
    users = cohort(select_users(tables, app), filters, app)
    if as_list(app) != [WEB_APP]:
        return users, None
    return users, cohort(select_users(tables, app, "LR"), filters, app)


def concat_tagged(frames: dict[str, DataFrame], tag: str = "app") -> DataFrame:
    """UNION ALL by name, missing columns NULL, with the frame's name in ``tag``."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combined_cohorts(
    tables: LearnerTables, filters: CohortFilter = CohortFilter(),
    apps: list[str] = config.APPS,
) -> tuple[DataFrame, DataFrame | None]:
    """Progress cohorts of all apps in one frame, and the launch cohorts in another."""
    pairs = {app: filtered_cohort(tables, [app], filters) for app in apps}
    launches = {app: lr for app, (_, lr) in pairs.items() if lr is not None}
    users = concat_tagged({app: df for app, (df, _) in pairs.items()})
    return users, concat_tagged(launches) if launches else None
