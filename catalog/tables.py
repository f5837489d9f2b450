"""Tables that later jobs read back instead of recomputing.

The feature table is written once per session and test folder, as the feature job
does in production; profiling, segmentation and reports then scan the stored copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.feature_queries import feature_table
from fleetcohort.sources.staging import stage

_written: dict[tuple[str, str, str], DataFrame] = {}


def written_once(spark: SparkSession, folder: str, label: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _written:
        _written[key] = stage(build(spark, folder), label)
    return _written[key]


def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    return written_once(spark, folder, "features", feature_table)
