"""Wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per (row, column); the columns are brought to double first."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(ids, columns, name, value)


def spread_struct(one_row: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A row of same-shaped structs, one per column, to one row per column."""
    entries = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`.*")) for c in columns]
    return one_row.select(F.inline(F.array(*entries)))
