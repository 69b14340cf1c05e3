"""Numeric expressions with the rounding and NULL rules the metrics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readtrail import config


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (array-library rounding)."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, NULL when whole is 0 or NULL."""
    return F.try_divide(part, whole) * F.lit(100)


def game_progress(level: Column, game_levels: Column) -> Column:
    """Percent of the game's levels reached; NULL for a game of unknown or zero length."""
    return percent_of(level, game_levels)


def is_learner_acquired(level: Column) -> Column:
    return level >= 1


def is_reader_acquired(level: Column) -> Column:
    return level >= config.READER_LEVEL


def is_game_completed(level: Column, gpc: Column) -> Column:
    return (level >= 1) & (gpc >= config.GAME_COMPLETE_PERCENT)


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def least_known(a: Column, b: Column) -> Column:
    """Smaller of the two, NULL when either is NULL (least() would skip the NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip_low(value: Column, low: int) -> Column:
    """Raise values below ``low`` to it; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))
