"""Readers for the raw logs and for derived tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetcohort.sources import schemas


class MissingSource(FileNotFoundError):
    """A required table is not there."""


@dataclass(frozen=True)
class RawLogs:
    """The five logs; one that was allowed to be absent, and is, is None."""

    profiles: DataFrame
    sessions: DataFrame
    trips: DataFrame | None
    incentives: DataFrame | None
    interactions: DataFrame | None


# Field of RawLogs -> (file stem, schema).
RAW_FILES = {
    "profiles": ("profile_data", schemas.PROFILES),
    "sessions": ("activity_logs", schemas.SESSIONS),
    "trips": ("trip_logs", schemas.TRIPS),
    "incentives": ("incentive_logs", schemas.INCENTIVES),
    "interactions": ("interaction_logs", schemas.INTERACTIONS),
}


def _open(spark: SparkSession, path: str, fmt: str, schema: StructType | None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        # Names in the header must match the pinned schema; a bad cell fails the job.
        reader = reader.options(header=True, enforceSchema=False, mode="FAILFAST")
    return reader.format(fmt).load(path)


def _is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def open_optional(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame | None:
    """The table, or None when nothing is stored at ``path``. Other errors propagate."""
    try:
        return _open(spark, path, fmt, schema)
    except AnalysisException as error:
        if _is_missing_path(error):
            return None
        raise


def open_required(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    table = open_optional(spark, path, fmt, schema)
    if table is None:
        raise MissingSource(f"no table at {path}")
    return table


def absent_logs(logs: RawLogs, *names: str) -> list[str]:
    """Which of these logs are not there."""
    return [name for name in names if getattr(logs, name) is None]


def load_raw_logs(
    spark: SparkSession, root: str, fmt: str = "csv", optional: Sequence[str] = ()
) -> RawLogs:
    """All five logs or an error naming every one that is missing; those listed as ``optional``
    (fields of ``RawLogs``) may be.

    ``fmt`` is ``csv`` (files ``<stem>.csv``) or any columnar format (folders ``<stem>``).
    """
    suffix = ".csv" if fmt == "csv" else ""
    opened, missing = {}, []
    for field, (stem, schema) in RAW_FILES.items():
        path = f"{root.rstrip('/')}/{stem}{suffix}"
        table = open_optional(spark, path, fmt, schema)
        if table is None and field not in optional:
            missing.append(path)
        opened[field] = table
    if missing:
        raise MissingSource("raw logs missing: " + ", ".join(missing))
    return RawLogs(**opened)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Fail while the plan is built, naming every absent column."""
    absent = [name for name in needed if name not in df.columns]
    if absent:
        raise KeyError(f"missing columns: {absent}")
    return df


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[name for name in wanted if name in df.columns])


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    from pyspark.sql.types import NumericType

    return [
        field.name
        for field in df.schema
        if isinstance(field.dataType, NumericType) and field.name not in exclude
    ]


def coerce_number(column: str):
    """Double value of a column; text that is not a number becomes NULL."""
    return F.col(column).cast("string").try_cast("double")
