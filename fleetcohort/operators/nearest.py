"""Nearest-centroid assignment."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_nearest(
    df: DataFrame, centroids: DataFrame, label: str, columns: list[str]
) -> DataFrame:
    """Adds ``label``: the centroid at the smallest squared distance, ties to the lowest.

    The centroid table (one row per cluster) travels as one array value, so no row
    of the large side is multiplied.
    """
    entries = F.array_sort(F.collect_list(F.struct(label, *columns)))
    packed = centroids.select(entries).scalar()

    def scored(c: Column) -> Column:
        parts = [(F.col(x) - c[x]) * (F.col(x) - c[x]) for x in columns]
        return F.struct(reduce(add, parts).alias("distance"), c[label].alias("label"))

    nearest = F.array_min(F.transform("_centroids", scored))["label"]
    return df.withColumn("_centroids", packed).withColumn(label, nearest).drop("_centroids")
