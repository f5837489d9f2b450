"""Arithmetic on columns with explicit NULL and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` in double, NULL when the denominator is 0 or NULL."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def real(value: Column) -> Column:
    """The value as a double; NaN, which files written elsewhere carry for missing, is NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def cents(amount: Column) -> Column:
    """Money as a whole number of cents (BIGINT): exact to add, cheap in generated code."""
    return F.rint(amount.cast("double") * 100).cast("bigint")


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    limited = F.greatest(F.lit(float(low)), F.least(value, F.lit(float(high))))
    return F.when(value.isNotNull(), limited)


def round_half_even(value: Column, places: int) -> Column:
    """Scale, round to the nearest even integer, scale back: array-library rounding."""
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def truncated_percent(share: Column, ceiling: int = 100) -> Column:
    """Whole percent, cut towards zero and capped; NULL stays NULL."""
    return F.when(share.isNotNull(), F.least((share * 100).cast("int"), F.lit(ceiling)))


def scale_min_max(value: Column, low: Column, high: Column) -> Column:
    """Position of a value between ``low`` and ``high``."""
    return (value - low) / F.nullif(high - low, F.lit(0.0))
