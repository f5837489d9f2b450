"""Display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcohort.functions.numeric import round_half_even


def fixed_text(value: Column, places: int) -> Column:
    """Fixed-decimal text of a value rounded half-even (the same digits in every engine)."""
    return F.format_string(f"%.{places}f", round_half_even(value, places))


def percent_text(share: Column, places: int = 1) -> Column:
    return F.concat(fixed_text(share * 100, places), F.lit("%"))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), fixed_text(amount, 2))


def short_id(key: Column, length: int = 8) -> Column:
    return F.substring(key.cast("string"), 1, length)


def title_label(name: Column) -> Column:
    """``trip_type`` -> ``Trip Type``."""
    return F.initcap(F.replace(F.trim(name), F.lit("_"), F.lit(" ")))
