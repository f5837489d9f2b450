"""Clock arithmetic on zone-less timestamps, reduced to whole seconds since 1970.

Working on integers keeps the session's time zone out of every result and stays
cheap in generated code: parsing a zone name per row is several times slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcohort.settings import LOCAL_ZONE

DAY = 86400
HOUR = 3600


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds between 1970-01-01 and a zone-less timestamp (BIGINT, dates from 1970)."""
    since = ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return since.cast("interval second").cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Number of second boundaries crossed, not of completed seconds."""
    return epoch_seconds(end) - epoch_seconds(start)


def hours_between(start: Column, end: Column) -> Column:
    """Number of hour boundaries crossed: 10:59 to 11:01 is one hour."""
    return F.floor(epoch_seconds(end) / HOUR) - F.floor(epoch_seconds(start) / HOUR)


def local_epoch_seconds(ts: Column, source_zone: str = "UTC", zone: str = LOCAL_ZONE) -> Column:
    """Local wall clock, as seconds since 1970, of a timestamp recorded in ``source_zone``."""
    instant = F.timestamp_seconds(epoch_seconds(ts))
    if source_zone != "UTC":
        instant = F.to_utc_timestamp(instant, source_zone)
    return F.unix_seconds(F.from_utc_timestamp(instant, zone))


def hour_of_day(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(DAY)) / HOUR)


def day_of_week(seconds: Column) -> Column:
    """Sunday is 0; 1970-01-01 was a Thursday."""
    return F.pmod(F.floor(seconds / DAY) + 4, F.lit(7))


# High demand on the local wall clock; day 0 is Sunday, each calendar day is judged on
# its own. The text form keeps one expression out of many small ones.
PEAK = """
    CASE WHEN {day} BETWEEN 1 AND 4 THEN {hour} BETWEEN 7 AND 9 OR {hour} BETWEEN 16 AND 18
         WHEN {day} = 5 THEN {hour} BETWEEN 7 AND 8 OR {hour} >= 16
         WHEN {day} = 6 THEN {hour} < 3 OR {hour} >= 22
         WHEN {day} = 0 THEN {hour} < 3 OR {hour} BETWEEN 11 AND 13 OR {hour} >= 22 END
"""


def is_peak(day: str, hour: str) -> Column:
    """True inside the demand windows, given the names of a weekday and an hour column.

    Every window starts and ends on a full hour, so the hour decides.
    """
    return F.expr(PEAK.format(day=day, hour=hour))
