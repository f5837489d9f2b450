"""Previous-row comparisons that do not gather a key in one task.

A window partitioned by the key alone would put all rows of one key, however many, into a
single task. Here rows are dealt out by key and stretch of the calendar, one *segment* each, in
one hash exchange: neighbours inside a segment are compared there, and what is carried from a
segment to the key's next one (over any that are empty) follows from one summary row per
(key, segment).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from fleetcohort.functions.temporal import DAY, epoch_seconds

#: Days of a segment: a few rows of an ordinary key, a small part of a very active one.
SEGMENT_DAYS = 7


def calendar_segment(moment: Column, days: int = SEGMENT_DAYS) -> Column:
    """Number of the stretch that a moment falls in; rows without one share a NULL segment,
    which comes first."""
    return F.floor(epoch_seconds(moment) / (days * DAY))


def segment_neighbours(
    key: str, order: list[str], segment: str = "segment"
) -> tuple[Callable[[str], Column], Column]:
    """Two column builders over the rows of a (key, segment), in order.

    The first gives a column of the row before, NULL on the first row. The second is true on
    the last row.
    """
    rows = Window.partitionBy(key, segment).orderBy(*order)

    def previous(column: str) -> Column:
        return F.lag(column).over(rows)

    return previous, F.lead(F.lit(True)).over(rows).isNull()
