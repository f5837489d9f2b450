"""Pinned schemas of the five raw logs and of the job outputs.

Clocks are zone-less. Money is read as double and summed in whole cents (see
``functions.numeric.cents``), so totals are exact and do not depend on the order in
which partitions are merged.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DoubleType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PROFILES = _table(
    ("driver_id", T.StringType()),
    ("signup_date", T.DateType()),
    ("vehicle_dispatchability", T.StringType()),
    ("avg_rating", T.DoubleType()),
    ("current_tier", T.StringType()),
    ("Churned", T.IntegerType()),
)

SESSIONS = _table(
    ("session_id", T.StringType()),
    ("driver_id", T.StringType()),
    ("session_start", T.TimestampNTZType()),
    ("session_end", T.TimestampNTZType()),
)

TRIPS = _table(
    ("trip_id", T.StringType()),
    ("driver_id", T.StringType()),
    ("request_time", T.TimestampNTZType()),
    ("pickup_time", T.TimestampNTZType()),
    ("trip_duration_seconds", T.IntegerType()),
    ("fare", MONEY),
    ("tip", MONEY),
    ("surge_multiplier", T.DoubleType()),
    ("pickup_lat", T.DoubleType()),
    ("pickup_long", T.DoubleType()),
    ("dropoff_lat", T.DoubleType()),
    ("dropoff_long", T.DoubleType()),
    ("trip_type", T.StringType()),
)

INCENTIVES = _table(
    ("incentive_id", T.StringType()),
    ("driver_id", T.StringType()),
    ("incentive_type", T.StringType()),
    ("offer_date", T.DateType()),
    ("status", T.StringType()),
    ("bonus_amount", MONEY),
)

INTERACTIONS = _table(
    ("event_id", T.StringType()),
    ("driver_id", T.StringType()),
    ("event_timestamp", T.TimestampNTZType()),
    ("event_type", T.StringType()),
)

DISPATCH_LOG = _table(
    ("timestamp", T.TimestampType()),
    ("recipient", T.StringType()),
    ("subject", T.StringType()),
    ("type", T.StringType()),
    ("status", T.StringType()),
    ("error", T.StringType()),
)

#: Stored log rows: with the batch and the attempt they were written by.
DISPATCH_ROWS = T.StructType(
    [*DISPATCH_LOG.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())]
)

DISPATCH_MANIFEST = _table(
    ("batch", T.StringType()), ("attempt", T.StringType()), ("committed", T.TimestampType())
)

RUN_LOG = _table(
    ("run_id", T.StringType()),
    ("kind", T.StringType()),
    ("key", T.StringType()),
    ("value", T.StringType()),
)
