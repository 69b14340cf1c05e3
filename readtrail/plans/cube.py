"""One aggregate behind all reports of a cohort: by country, by language and in total.

Each report used to fold the learner table anew.  The cube folds it once, by grouping sets:
rows go to (country, learner), (language, learner) and (learner) in one pass, and from there
to groups.  It has as many rows as there are countries and languages, and is staged; maps,
top lists, steps and tiles are read off it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.operators.cohorts import CohortFilter, LearnerTables, app_kind, combined_cohorts, filtered_cohort
from readtrail.operators.funnel import (
    funnel_columns,
    funnel_steps_of,
    learner_folds,
    learner_totals,
    sorted_funnel,
    user_key_of,
)
from readtrail.plans.reports import steps_table
from readtrail.sources.snapshots import stage

BY = ["country", "app_language"]
_STEPS = [s for s in config.FUNNEL_SIZES["large"] if s != "LR"]


def _grouped(df: DataFrame, key: str, folds: list[Column], totals: list[Column]) -> DataFrame:
    """Totals of the groups of each column of BY (`by` names it) and of all rows (`by` is total).

    Groups that are NULL are kept; `group` is NULL in the total too.
    """
    rows = df.withColumn("_user", F.col(key))
    sets = [[c, "_user"] for c in BY] + [["_user"]]
    level = F.grouping_id(*[F.col(c) for c in [*BY, "_user"]]).alias("level")
    per_learner = rows.groupingSets(sets, *BY, "_user").agg(level, *folds)
    # bits of the level are set for columns that a set leaves out; the user's is never set
    by = F.when(F.col("level") == 2, BY[0]).when(F.col("level") == 4, BY[1]).otherwise("total")
    named = per_learner.select("*", by.alias("by"), F.coalesce(*BY).alias("group"))
    return named.groupBy("by", "group").agg(*totals)


def build_cube(users: DataFrame, reached: DataFrame | None, key: str) -> DataFrame:
    """Cube of a progress cohort, with learners reached from a launch cohort if there is one.

    ``LR`` are distinct learners of the progress cohort, ``reached`` of the launch cohort;
    ``users`` and ``reached_rows`` count rows.
    """
    own = _grouped(
        users, key, [*learner_folds(_STEPS), F.count(F.lit(1)).alias("rows")],
        [*learner_totals(_STEPS), F.sum("rows").alias("users")],
    ).withColumns({"reached": F.lit(None).cast("bigint"), "reached_rows": F.lit(None).cast("bigint")})
    if reached is not None:
        lr = _grouped(
            reached, key, [F.count(F.lit(1)).alias("rows")],
            [F.count("_user").alias("reached"), F.sum("rows").alias("reached_rows")],
        )
        own = own.unionByName(lr, allowMissingColumns=True)
    sums = [c for c in own.columns if c not in ("by", "group")]
    return own.groupBy("by", "group").agg(*[F.sum(c).alias(c) for c in sums])


@dataclass(frozen=True)
class ReportCube:
    """Reports of one app (or All) and one filter, from its cube."""

    app: str
    frame: DataFrame
    has_launches: bool

    def reached(self, by: str = "country") -> DataFrame:
        """Learners reached per group, of the launch cohort if there is one; the NULL group included."""
        lr = F.col("reached" if self.has_launches else "LR")
        rows = self.frame.where((F.col("by") == by) & lr.isNotNull())
        return rows.select(F.col("group").alias(by), lr.alias("LR"), F.lit(100.0).alias("LR_pct"))

    def funnel(self, by: str = "country", min_funnel: bool = False) -> DataFrame:
        rows = self.frame.where((F.col("by") == by) & F.col("group").isNotNull() & F.col("LR").isNotNull())
        if self.has_launches and self.app != "All":
            rows = rows.withColumn("LR", F.coalesce("reached", F.lit(0).cast("bigint")))
        return funnel_columns(rows.withColumnRenamed("group", by), by, funnel_steps_of(self.app, min_funnel))

    def map(self, stat: str = "LR", sort_by: str = "Total") -> DataFrame:
        """Countries by a metric; for LR the learners reached alone, if there is a launch cohort."""
        return self.top(stat, "country", sort_by.lower() == "percent", None)

    def top(self, stat: str = "LA", by: str = "country", percent: bool = False, n: int | None = 10) -> DataFrame:
        table = self.reached(by) if stat == "LR" and self.has_launches else self.funnel(by, min_funnel=True)
        return sorted_funnel(table, stat, "Percent" if percent else "Total", top=n)

    def steps(self, size: str | None = None) -> DataFrame:
        """Steps of the funnel figure, each summed over languages."""
        size = size or app_kind([self.app]).funnel
        stats = config.FUNNEL_SIZES[size]
        funnel = self.funnel("app_language", size == "compact")
        zero = F.lit(0).cast("bigint")
        totals = funnel.agg(*[(F.coalesce(F.sum(s), zero) if s in funnel.columns else zero).alias(s) for s in stats])
        return steps_table(totals, stats)

    def tiles(self) -> DataFrame:
        """LR as rows of the launch (or progress) cohort, and LA, RA, GC."""
        total = self.frame.where("by = 'total'")
        zero = F.lit(0).cast("bigint")
        reached = F.sum("reached_rows" if self.has_launches else "users")
        return total.agg(
            F.coalesce(reached, zero).alias("LR"), *[F.coalesce(F.sum(s), zero).alias(s) for s in ("LA", "RA", "GC")]
        ).select(F.lit(self.app).alias("app"), "*")


def report_cube(
    tables: LearnerTables, app: str, filters: CohortFilter = CohortFilter(), staging: str | None = None
) -> ReportCube:
    """The cube of an app's cohort; each learner table is scanned once."""
    if app == "All":
        users, launches = combined_cohorts(tables, filters)
    else:
        users, launches = filtered_cohort(tables, [app], filters)
    cube = build_cube(users, launches, user_key_of(app))
    return ReportCube(app, stage(cube, staging), launches is not None)
