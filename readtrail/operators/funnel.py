"""Funnel metrics of a cohort: totals, per group, per app and over all apps.

Every table here comes from one aggregate with conditional sums.  Where distinct
learners are counted, rows are first folded per (group, learner), which spreads a
group that holds much of the cohort over the cluster; the fold to groups then
works on partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail import config
from readtrail.functions import numbers as N
from readtrail.operators.cohorts import (
    CohortFilter,
    LearnerTables,
    app_name,
    as_list,
    filtered_cohort,
)

_STEP_STAGE = {"DC": 1, "TS": 2, "SL": 3, "PC": 4}


def step_condition(step: str) -> Column:
    """Whether a learner row counts for a funnel step other than LR."""
    level = F.col("max_user_level")
    if step in _STEP_STAGE:
        reached = [e for e, n in config.STAGE_NUMBERS.items() if n >= _STEP_STAGE[step]]
        return F.col("furthest_event").isin(reached)
    return {
        "LA": N.is_learner_acquired(level),
        "RA": N.is_reader_acquired(level),
        "GC": N.is_game_completed(level, F.col("gpc")),
    }[step]


def _step_count(step: str) -> Column:
    return F.count(F.lit(1)) if step == "LR" else F.count_if(step_condition(step))


def cohort_totals(cohort_df: DataFrame, stats: list[str] = config.FUNNEL_SIZES["large"]) -> DataFrame:
    """One row of step totals; LR is the number of rows."""
    return cohort_df.agg(*[_step_count(s).alias(s) for s in stats])


def funnel_steps_of(app: list[str] | str | None, min_funnel: bool) -> list[str]:
    full = app_name(app) == "CR" and not min_funnel
    return config.FUNNEL_SIZES["large" if full else "compact"]


def user_key_of(app: list[str] | str | None) -> str:
    return "user_pseudo_id" if app_name(app) == "Unity" else "cr_user_id"


def _with_user_key(df: DataFrame, user_key: str) -> DataFrame:
    """Add the counting key ``_user``; "coalesce" lets legacy users count by device."""
    if user_key == "coalesce":
        key = F.coalesce(F.col("cr_user_id"), F.col("user_pseudo_id"))
    else:
        key = F.col(user_key)
    return df.withColumn("_user", key)


def _learners_per_group(df: DataFrame, by: str, user_key: str) -> DataFrame:
    return _with_user_key(df, user_key).groupBy(by).agg(F.count_distinct("_user").alias("LR"))


def lr_by_group(
    cohort_df: DataFrame, by: str = "app_language", app: list[str] | str | None = None,
    user_key: str | None = None,
) -> DataFrame:
    """Distinct learners per group, the NULL group included."""
    return _learners_per_group(cohort_df, by, user_key or user_key_of(app)).withColumn(
        "LR_pct", F.lit(100.0)
    )


def funnel_by_group(
    cohort_df: DataFrame,
    cohort_lr: DataFrame | None = None,
    by: str = "app_language",
    app: list[str] | str | None = None,
    min_funnel: bool = False,
    user_key: str | None = None,
) -> DataFrame:
    """Funnel per group: step counts, percent of LR, mean progress, completion.

    LR counts distinct learners, of the launch cohort for CR when one is given.
    Groups that are NULL or have no step after LR are left out.  A percentage of no
    learners is NULL.  A cohort without a furthest_event column (launches) gives LR
    only.  ``user_key="coalesce"`` also counts users who have a device id only.
    """
    key = user_key or user_key_of(app)
    if "furthest_event" not in cohort_df.columns:
        return lr_by_group(cohort_df, by, app, key)

    steps = funnel_steps_of(app, min_funnel)
    later = [s for s in steps if s != "LR"]
    has_gpc = "gpc" in cohort_df.columns
    folds, totals = learner_folds(later, has_gpc), learner_totals(later)
    per_learner = _with_user_key(cohort_df.where(F.col(by).isNotNull()), key).groupBy(by, "_user").agg(*folds)
    groups = per_learner.groupBy(by).agg(*totals)
    if cohort_lr is not None and app_name(app) == "CR":
        reached = _learners_per_group(cohort_lr.where(F.col(by).isNotNull()), by, key)
        groups = groups.drop("LR").join(reached, by, "left").withColumn(
            "LR", F.coalesce(F.col("LR"), F.lit(0))
        )
    return funnel_columns(groups, by, steps, has_gpc)


def learner_folds(steps: list[str], has_gpc: bool = True) -> list[Column]:
    """What the rows of one learner in one group add up to."""
    acquired = N.is_learner_acquired(F.col("max_user_level"))
    completed = N.is_game_completed(F.col("max_user_level"), F.col("gpc")) if has_gpc else F.lit(False)
    progress = F.col("gpc") if has_gpc else F.lit(None).cast("double")
    return [
        *[_step_count(s).alias(s) for s in steps],
        F.count_if(acquired).alias("la_rows"),
        F.sum(F.when(acquired, progress)).alias("gpc_sum"),
        F.count(F.when(acquired, progress)).alias("gpc_rows"),
        F.max(N.flag(acquired)).alias("is_la"),
        F.max(N.flag(completed)).alias("is_complete"),
    ]


def learner_totals(steps: list[str]) -> list[Column]:
    """What the learners of a group, folded by :func:`learner_folds`, add up to."""
    known = F.col("_user").isNotNull()
    return [
        F.count("_user").alias("LR"),
        *[F.sum(s).alias(s) for s in steps],
        *[F.sum(c).alias(c) for c in ("la_rows", "gpc_sum", "gpc_rows")],
        F.sum(F.when(known, F.col("is_la"))).alias("la_learners"),
        F.sum(F.when(known, F.col("is_complete"))).alias("complete_learners"),
    ]


def funnel_columns(groups: DataFrame, by: str, steps: list[str], has_gpc: bool = True) -> DataFrame:
    """Funnel table from totals per group; groups without any step after LR are left out."""
    later = [s for s in steps if s != "LR"]
    groups = groups.where(reduce(lambda a, b: a | b, [F.col(s) > 0 for s in later]))
    columns = [F.col(by)] + [F.col(s) for s in steps] + [F.lit(100.0).alias("LR_pct")]
    columns += [N.percent_of(F.col(s), F.col("LR")).alias(f"{s}_pct") for s in later]
    if has_gpc:
        has_la = F.col("la_rows") > 0
        # learners without a known game length count as no progress only if all lack it
        gpp = F.when(
            has_la, F.coalesce(F.try_divide(F.col("gpc_sum"), F.col("gpc_rows")), F.lit(0.0))
        )
        share = F.try_divide(F.col("complete_learners"), F.col("la_learners")) * 100
        gca = F.when(has_la, N.round_half_even(share, 2))
        columns += [gpp.alias("GPP"), gpp.alias("GPP_pct"), gca.alias("GCA"), gca.alias("GCA_pct")]
    return groups.select(*columns)


# columns that order a table by share; LR and the derived metrics are ordered by their value
_SHARES = {step: f"{step}_pct" for step in config.STEP_TITLES if step != "LR"}
_ORDERS = {"total": {}, "percent": _SHARES}


def sort_column(funnel: DataFrame, stat: str, sort_by: str = "Total") -> str:
    """Column a funnel table is ordered by; raises for a metric it does not have."""
    metric = stat.strip().upper()
    column = _ORDERS[sort_by.lower()].get(metric, metric)
    if column in funnel.columns:
        return column
    raise KeyError(f"no metric {column!r}; the table has {funnel.columns}")


def sorted_funnel(
    funnel: DataFrame, stat: str = "LA", sort_by: str = "Total", ascending: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Funnel table ordered by a metric, unknown values last; ``top`` keeps that many."""
    metric = F.col(sort_column(funnel, stat, sort_by))
    group = F.col(funnel.columns[0])
    order = metric.asc_nulls_last() if ascending else metric.desc_nulls_last()
    ordered = funnel.orderBy(order, group.asc_nulls_last())
    return ordered if top is None else ordered.limit(top)


def top(funnel: DataFrame, stat: str = "LA", sort_by: str = "Total", n: int = 10) -> DataFrame:
    return sorted_funnel(funnel, stat, sort_by, top=n)


_SUMS = ["la_rows", "complete_rows", "gpc_sum", "gpc_rows"]


def _app_partials(app: str, tables: LearnerTables, filters: CohortFilter, steps: list[str]) -> DataFrame:
    """Summable parts of one app's totals; LR may come in a row of its own."""
    users, launches = filtered_cohort(tables, [app], filters)
    key = user_key_of(app)
    later = [s for s in steps if s != "LR"]
    acquired = N.is_learner_acquired(F.col("max_user_level"))
    per_learner = users.groupBy(key).agg(
        *[_step_count(s).alias(s) for s in later],
        F.count_if(acquired).alias("la_rows"),
        F.count_if(step_condition("GC")).alias("complete_rows"),
        F.sum(F.when(acquired, F.col("gpc"))).alias("gpc_sum"),
        F.count(F.when(acquired, F.col("gpc"))).alias("gpc_rows"),
    )
    learners = F.count(key) if launches is None else F.lit(0).cast("bigint")
    totals = per_learner.agg(
        learners.alias("LR"), *[F.sum(c).alias(c) for c in [*later, *_SUMS]]
    )
    if launches is not None:
        reached = launches.agg(F.count_distinct(key).alias("LR"))
        totals = totals.unionByName(reached, allowMissingColumns=True)
    return totals.withColumn("app", F.lit(app))


def app_funnel(
    apps: list[str] | str, tables: LearnerTables, filters: CohortFilter = CohortFilter(),
    size: str = "compact",
) -> DataFrame:
    """One row of funnel totals per app.

    LR counts distinct learners (launches for CR).  GPP and GCA are over learner
    rows here, not rounded, an unknown progress counting as not complete; both are 0
    for an app without an acquired learner.
    """
    steps = config.FUNNEL_SIZES["large" if size == "large" else "compact"]
    parts = reduce(
        DataFrame.unionByName, [_app_partials(a, tables, filters, steps) for a in as_list(apps)]
    )
    sums = parts.groupBy("app").agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps],
        *[F.sum(c).alias(c) for c in _SUMS],
    )
    has_la = F.coalesce(F.col("la_rows"), F.lit(0)) > 0
    gpp = F.when(has_la, F.try_divide(F.col("gpc_sum"), F.col("gpc_rows"))).otherwise(0.0)
    gca = F.when(has_la, F.col("complete_rows") / F.col("la_rows") * 100).otherwise(0.0)
    return sums.select("app", *steps, gpp.alias("GPP"), gca.alias("GCA"))


_GLOBAL_COUNTS = ["LR", "LA", "RA", "GC"]


def all_apps_metrics(funnels: DataFrame) -> DataFrame:
    """Totals over the rows of :func:`app_funnel`; GPP and GCA weighted by LR.

    An app with learners but an unknown GPP makes the weighted GPP unknown.
    """
    weight = F.col("LR")
    counts = [F.sum(c).alias(c) for c in _GLOBAL_COUNTS]
    total = F.sum(weight)

    def weighted(column: str) -> Column:
        value = F.col(column)
        unknown = F.coalesce(F.max(N.flag(value.isNull() & (weight > 0))), F.lit(0)) == 1
        mean = F.when(total > 0, F.sum(value * weight) / total).otherwise(0.0)
        return F.when(~unknown, mean).alias(column)

    return funnels.agg(*counts, weighted("GPP"), weighted("GCA"))


def global_metrics(funnel: DataFrame) -> DataFrame:
    """Totals of a funnel table; GPP and GCA weighted by LR, missing columns 0.

    A group of unknown GPP adds nothing to the sum but keeps its weight.
    """
    zero, has = F.lit(0).cast("bigint"), funnel.columns
    total = F.coalesce(F.sum("LR"), zero) if "LR" in has else zero

    def mean(column: str) -> Column:
        if column not in has or "LR" not in has:
            return F.lit(0.0).alias(column)
        part = F.coalesce(F.sum(F.col(column) * F.col("LR")), F.lit(0.0))
        return F.when(total > 0, part / total).otherwise(0.0).alias(column)

    counts = [
        (F.coalesce(F.sum(c), zero) if c in has else zero).alias(c) for c in _GLOBAL_COUNTS
    ]
    return funnel.agg(*counts, mean("GPP"), mean("GCA"))
