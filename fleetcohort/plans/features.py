"""Driver features: five raw logs to one behavioural row per driver.

Each raw log is aggregated once, by one partial + final hash aggregation on
``driver_id``; the four results are left-joined onto the profile spine. All of them
leave their aggregation partitioned by ``driver_id``, so only the spine moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcohort.functions.mapping import contains_any, tier_rank
from fleetcohort.functions.numeric import cents
from fleetcohort.functions.temporal import (
    day_of_week,
    hour_of_day,
    hours_between,
    is_peak,
    local_epoch_seconds,
    seconds_between,
)
from fleetcohort.operators.ordering import calendar_segment, segment_neighbours
from fleetcohort.settings import FEATURE_COLUMNS, PREMIUM_TRIP_TYPES
from fleetcohort.sources.raw import RawLogs

KEY = "driver_id"


# --- one aggregation per log -------------------------------------------------


def trip_totals(trips: DataFrame, source_zone: str = "UTC") -> DataFrame:
    """Everything the features need from trips, one row per driver."""
    # Each step feeds several uses in the next one, so each is its own projection.
    priced = trips.select(
        KEY,
        "trip_id",
        "fare",
        cents(F.col("fare")).alias("fare_cents"),
        cents(F.col("tip")).alias("tip_cents"),
        "trip_duration_seconds",
        F.col("trip_type").isin(PREMIUM_TRIP_TYPES).alias("premium"),
        F.expr("fare / nullif(surge_multiplier, 0D)").alias("base"),
        local_epoch_seconds(F.col("request_time"), source_zone).alias("local"),
    )
    clocked = priced.withColumns(
        {"local_day": day_of_week(F.col("local")), "local_hour": hour_of_day(F.col("local"))}
    )
    return clocked.groupBy(KEY).agg(
        F.expr("sum(fare_cents + tip_cents)").alias("trip_cents"),
        F.sum("fare_cents").alias("fare_cents"),
        F.sum("tip_cents").alias("tip_cents"),
        F.sum("trip_duration_seconds").alias("trip_seconds"),
        F.expr("sum(fare - base)").alias("surge_premium"),
        F.sum("base").alias("base_fare"),
        F.count("trip_id").alias("trip_count"),
        F.count_if("premium").alias("premium_trips"),
        F.count_if(is_peak("local_day", "local_hour")).alias("peak_trips"),
    )


def online_totals(sessions: DataFrame) -> DataFrame:
    """Online seconds per driver, when the gaps are not needed."""
    seconds = seconds_between(F.col("session_start"), F.col("session_end"))
    return sessions.groupBy(KEY).agg(
        F.sum(seconds).alias("online_seconds"), F.count(F.lit(1)).alias("session_count")
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    """Online seconds, session count and the moments of the gaps between sessions.

    Gaps are whole hours, so their moments are exact integers and add up the same way
    whatever the segmentation.
    """
    order = ["session_start", "session_id"]
    previous, is_last = segment_neighbours(KEY, order)
    inside = sessions.select(
        KEY,
        calendar_segment(F.col("session_start")).alias("segment"),
        "session_id",
        "session_start",
        "session_end",
    ).select(
        "segment",
        KEY,
        "session_start",
        "session_end",
        previous("session_end").alias("previous_end"),
        is_last.alias("is_last"),
    )
    measured = inside.withColumns(
        {
            "gap": hours_between(F.col("previous_end"), F.col("session_start")),
            "seconds": seconds_between(F.col("session_start"), F.col("session_end")),
        }
    )
    parts = measured.groupBy(KEY, "segment").agg(
        F.min("session_start").alias("first_start"),
        F.max(F.when(F.col("is_last"), F.col("session_end"))).alias("last_end"),
        F.sum("seconds").alias("seconds"),
        F.count(F.lit(1)).alias("sessions"),
        F.count("gap").alias("gaps"),
        F.sum("gap").alias("gap_sum"),
        F.sum(F.col("gap") * F.col("gap")).alias("gap_squares"),
    )
    # One row per segment that holds the driver: a short window.
    chain = Window.partitionBy(KEY).orderBy("segment")
    seam = hours_between(F.lag("last_end").over(chain), F.col("first_start"))
    return (
        parts.withColumn("seam", seam)
        .groupBy(KEY)
        .agg(
            F.sum("seconds").alias("online_seconds"),
            F.sum("sessions").alias("session_count"),
            (F.sum("gaps") + F.count("seam")).alias("gap_count"),
            _plus(F.sum("gap_sum"), F.sum("seam")).alias("gap_sum"),
            _plus(F.sum(_wide("gap_squares")), F.sum(_wide("seam") * _wide("seam"))).alias(
                "gap_squares"
            ),
        )
    )


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _plus(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


def incentive_totals(incentives: DataFrame) -> DataFrame:
    # Other rows touch no total, and a driver left without rows gets the same NULLs.
    return (
        incentives.filter("incentive_type = 'Quest' OR status = 'completed'")
        .groupBy(KEY)
        .agg(
            F.expr("count_if(incentive_type = 'Quest')").alias("quests"),
            F.expr("count_if(incentive_type = 'Quest' AND status = 'completed')").alias("quests_done"),
            F.sum(F.when(F.col("status") == "completed", cents(F.col("bonus_amount")))).alias(
                "bonus_cents"
            ),
        )
    )


def interaction_totals(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy(KEY).agg(
        F.expr("count_if(event_type = 'trip_accepted')").alias("accepted"),
        F.expr("count_if(event_type = 'trip_cancelled')").alias("cancelled"),
        F.expr("count_if(event_type = 'trip_ignored')").alias("ignored"),
    )


# --- feature formulas over the totals ----------------------------------------

FORMULAS = {
    "avg_earnings_per_hour_online": """
        (coalesce(trip_cents, 0) / 100D) / nullif(online_seconds / 3600D, 0D)""",
    # ``least`` skips NULL: a driver whose sessions last zero seconds scores 1.0.
    "trip_utilization_rate": """
        CASE WHEN session_count IS NOT NULL
             THEN least(coalesce(trip_seconds, 0) / nullif(CAST(online_seconds AS DOUBLE), 0D), 1D)
        END""",
    "surge_reliance_score": "surge_premium / nullif(base_fare, 0D)",
    "premium_trip_ratio": "coalesce(premium_trips / nullif(CAST(trip_count AS DOUBLE), 0D), 0D)",
    "peak_hour_driver_score": "peak_trips / nullif(CAST(trip_count AS DOUBLE), 0D)",
    # Sample standard deviation from integer moments; 0 below two gaps.
    "session_regularity": """
        CASE WHEN gap_count > 1 THEN
               sqrt(CAST(CAST(gap_count AS DECIMAL(18, 0)) * CAST(gap_squares AS DECIMAL(38, 0))
                         - CAST(gap_sum AS DECIMAL(19, 0)) * CAST(gap_sum AS DECIMAL(19, 0))
                         AS DOUBLE)
                    / (CAST(gap_count AS DOUBLE) * CAST(gap_count - 1 AS DOUBLE)))
             WHEN session_count IS NOT NULL THEN 0D END""",
    "quest_completion_rate": "quests_done / nullif(CAST(quests AS DOUBLE), 0D)",
    "incentive_reliance_pct": """
        (coalesce(bonus_cents, 0) / 100D)
        / nullif(coalesce(bonus_cents, 0) / 100D + coalesce(fare_cents, 0) / 100D
                 + coalesce(tip_cents, 0) / 100D, 0D)""",
    "cancellation_rate": "cancelled / nullif(CAST(accepted + cancelled AS DOUBLE), 0D)",
    "acceptance_rate": "accepted / nullif(CAST(accepted + ignored AS DOUBLE), 0D)",
}


def feature(name: str) -> Column:
    return F.expr(FORMULAS[name]).alias(name)


def premium_capable() -> Column:
    flag = contains_any(F.col("vehicle_dispatchability"), PREMIUM_TRIP_TYPES)
    return flag.alias("is_premium_capable")


# --- single features ----------------------------------------------------------


def earnings_per_hour(sessions: DataFrame, trips: DataFrame) -> DataFrame:
    joined = online_totals(sessions).join(trip_totals(trips), KEY, "left")
    return joined.select(KEY, feature("avg_earnings_per_hour_online"))


def trip_utilization(sessions: DataFrame, trips: DataFrame) -> DataFrame:
    joined = online_totals(sessions).join(trip_totals(trips), KEY, "left")
    return joined.select(KEY, feature("trip_utilization_rate"))


def surge_reliance(trips: DataFrame) -> DataFrame:
    return trip_totals(trips).select(KEY, feature("surge_reliance_score"))


def premium_strategy(profiles: DataFrame, trips: DataFrame) -> DataFrame:
    joined = profiles.join(trip_totals(trips), KEY, "left")
    return joined.select(KEY, premium_capable(), feature("premium_trip_ratio"))


def peak_hours(trips: DataFrame, source_zone: str = "UTC") -> DataFrame:
    return trip_totals(trips, source_zone).select(KEY, feature("peak_hour_driver_score"))


def session_regularity(sessions: DataFrame) -> DataFrame:
    return session_totals(sessions).select(KEY, feature("session_regularity"), "session_count")


def quest_completion(incentives: DataFrame) -> DataFrame:
    """Every driver with any incentive gets a row, with NULL when none was a Quest."""
    totals = incentives.groupBy(KEY).agg(
        F.expr("count_if(incentive_type = 'Quest')").alias("quests"),
        F.expr("count_if(incentive_type = 'Quest' AND status = 'completed')").alias("quests_done"),
    )
    return totals.select(KEY, feature("quest_completion_rate"))


def incentive_reliance(incentives: DataFrame, trips: DataFrame) -> DataFrame:
    """Drivers with a completed incentive or a trip, from either side."""
    bonus = (
        incentives.filter(F.col("status") == "completed")
        .groupBy(KEY)
        .agg(F.sum(cents(F.col("bonus_amount"))).alias("bonus_cents"))
    )
    return bonus.join(trip_totals(trips), KEY, "full").select(
        KEY,
        F.expr("coalesce(bonus_cents, 0) / 100D").alias("total_bonus_earned"),
        F.expr("coalesce(fare_cents, 0) / 100D").alias("total_fare_earned"),
        F.expr("coalesce(tip_cents, 0) / 100D").alias("total_tip_earned"),
        feature("incentive_reliance_pct"),
    )


def tier_ranks(profiles: DataFrame) -> DataFrame:
    return profiles.select(KEY, tier_rank("current_tier").alias("pro_tier_rank"))


def cancellation(interactions: DataFrame) -> DataFrame:
    return interaction_totals(interactions).select(KEY, feature("cancellation_rate"))


def acceptance(interactions: DataFrame) -> DataFrame:
    return interaction_totals(interactions).select(KEY, feature("acceptance_rate"))


# --- the feature table ----------------------------------------------------------


def driver_features(logs: RawLogs, source_zone: str = "UTC") -> DataFrame:
    """One row per profile, 18 columns in contract order."""
    # Other events enter no rate; here, unlike in the single features, a driver without
    # a counted event needs no row, so the filter can reach the scan.
    counted = logs.interactions.filter(
        "event_type IN ('trip_accepted', 'trip_cancelled', 'trip_ignored')"
    )
    joined = (
        logs.profiles.join(trip_totals(logs.trips, source_zone), KEY, "left")
        .join(session_totals(logs.sessions), KEY, "left")
        .join(incentive_totals(logs.incentives), KEY, "left")
        .join(interaction_totals(counted), KEY, "left")
    )
    computed = {name: feature(name) for name in FORMULAS}
    computed["is_premium_capable"] = premium_capable()
    computed["pro_tier_rank"] = tier_rank("current_tier").alias("pro_tier_rank")
    return joined.select(*[computed.get(name, name) for name in FEATURE_COLUMNS])
