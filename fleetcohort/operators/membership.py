"""Membership of a row's key in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_membership(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds a boolean: does ``key`` occur in ``members``? Every row stays exactly once."""
    known = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_semi")
