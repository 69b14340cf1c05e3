"""Distinct learners that add up: bitmaps per day, country, language and app.

A count of distinct learners cannot be summed over days, a set of learners can be joined.
Learners get dense numbers once (:func:`learner_codes`); a set is then a bitmap, cut into
buckets of 32,768 numbers.  Numbers follow first day, country and language, so the learners
of a group lie in few buckets and a bitmap is mostly full.  Any range of days and choice of
countries and languages is a bitwise or over the groups inside, exactly.  Sums that do add
up (rows per step) lie beside in a table of the same groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtrail.functions import numbers as N
from readtrail.operators.cohorts import CohortFilter, cohort
from readtrail.operators.funnel import funnel_columns, funnel_steps_of, step_condition
from readtrail.sources.snapshots import stage

GROUP = ["first_open", "country", "app_language", "app"]
_ORDER = ["first_open", "country", "app_language"]
STEPS = ["DC", "TS", "SL", "PC", "LA", "RA", "GC"]


def learner_codes(
    learners: DataFrame, key: str, staging: str, known: DataFrame | None = None
) -> DataFrame:
    """`key`, `code`: a dense number from 0 for every learner.

    ``known`` codes stay as they are, new learners get the numbers after them, so bitmaps of
    earlier nights stay valid.  Learners are range-partitioned and staged with the number of
    their partition; one count per partition is carried onward.
    """
    new = learners.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in _ORDER])
    start = 0
    if known is not None:
        new = new.join(known, key, "left_anti")
        start = known.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    order = [*_ORDER, key]
    parts = stage(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), staging)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    coded = parts.withColumn("_place", place).join(offsets, "_part").select(
        key, (F.lit(start) + F.col("_before") + F.col("_place")).cast("bigint").alias("code")
    )
    return coded if known is None else known.select(key, "code").unionByName(coded)


def _bitmap(condition: Column | None = None) -> Column:
    position = F.bitmap_bit_position("code")
    return F.bitmap_construct_agg(position if condition is None else F.when(condition, position))


@dataclass(frozen=True)
class FunnelBitmaps:
    """Sets and sums per (day, country, language, app).

    reached   bucket and the bitmap of learners reached, from the launch table
    learners  bucket and the bitmaps of learners, those acquired and those who completed the game
    sums      rows per funnel step, and progress of acquired learners
    """

    reached: DataFrame
    learners: DataFrame
    sums: DataFrame


def funnel_bitmaps(users: DataFrame, launches: DataFrame, codes: DataFrame, key: str = "cr_user_id") -> FunnelBitmaps:
    """From the cleaned progress and launch tables; a learner without a key is in no set."""
    level, acquired = F.col("max_user_level"), N.is_learner_acquired(F.col("max_user_level"))
    bucket = F.bitmap_bucket_number("code").alias("bucket")
    reached = launches.join(codes, key).withColumn("app", F.lit(None).cast("string"))
    learners = users.join(codes, key)
    return FunnelBitmaps(
        reached.groupBy(*GROUP, bucket).agg(_bitmap().alias("reached")),
        learners.groupBy(*GROUP, bucket).agg(
            _bitmap().alias("learners"), _bitmap(acquired).alias("acquired"),
            _bitmap(N.is_game_completed(level, F.col("gpc"))).alias("completed"),
        ),
        users.groupBy(*GROUP).agg(
            *[F.count_if(step_condition(s)).alias(s) for s in STEPS],
            F.count_if(acquired).alias("la_rows"),
            F.sum(F.when(acquired, F.col("gpc"))).alias("gpc_sum"),
            F.count(F.when(acquired, F.col("gpc"))).alias("gpc_rows"),
        ),
    )


def distinct_by(sets: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
    """Distinct learners per group: bitmaps are joined per bucket, then counted (column: result)."""
    joined = sets.groupBy(by, "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in names])
    return joined.groupBy(by).agg(*[F.sum(F.bitmap_count(c)).alias(n) for c, n in names.items()])


def funnel_of_bitmaps(
    cube: FunnelBitmaps, filters: CohortFilter = CohortFilter(), by: str = "country", app: str = "CR",
    min_funnel: bool = False,
) -> DataFrame:
    """:func:`~readtrail.operators.funnel.funnel_by_group` of any cohort, by merging groups."""
    steps = funnel_steps_of(app, min_funnel)
    known = F.col(by).isNotNull()
    summed = [s for s in steps if s != "LR"] + ["la_rows", "gpc_sum", "gpc_rows"]
    sums = cohort(cube.sums, filters, app).where(known).groupBy(by).agg(*[F.sum(c).alias(c) for c in summed])
    learners = distinct_by(
        cohort(cube.learners, filters, app).where(known), by,
        {"learners": "own_LR", "acquired": "la_learners", "completed": "complete_learners"},
    )
    groups = sums.join(learners, by, "left")
    if app == "CR":
        reached = distinct_by(cohort(cube.reached.drop("app"), filters).where(known), by, {"reached": "LR"})
        groups = groups.join(reached, by, "left")
    else:
        groups = groups.withColumn("LR", F.col("own_LR"))
    groups = groups.fillna(0, ["LR", "la_learners", "complete_learners"])
    return funnel_columns(groups, by, steps)
