"""Feature queries FT1-FT14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.oracle_base import rounded, sql
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.plans import features
from fleetcohort.sources import fixture


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), places) for c in columns})


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return features.driver_features(fixture.raw_logs(spark, folder))


QUERIES = {
    "feat_earnings_per_hour": lambda s, d: features.earnings_per_hour(
        fixture.sessions(s, d), fixture.trips(s, d)
    ),
    "feat_utilization": lambda s, d: features.trip_utilization(
        fixture.sessions(s, d), fixture.trips(s, d)
    ),
    "feat_surge": lambda s, d: _rounded(
        features.surge_reliance(fixture.trips(s, d)), 4, "surge_reliance_score"
    ),
    "feat_premium": lambda s, d: features.premium_strategy(
        fixture.profiles(s, d), fixture.trips(s, d)
    ),
    "feat_peak_hours": lambda s, d: features.peak_hours(fixture.trips(s, d)),
    "feat_regularity": lambda s, d: _rounded(
        features.session_regularity(fixture.sessions(s, d)), 4, "session_regularity"
    ),
    "feat_quest": lambda s, d: features.quest_completion(fixture.incentives(s, d)),
    "feat_incentive_reliance": lambda s, d: features.incentive_reliance(
        fixture.incentives(s, d), fixture.trips(s, d)
    ),
    "feat_tier_rank": lambda s, d: features.tier_ranks(fixture.profiles(s, d)),
    "feat_cancellation": lambda s, d: features.cancellation(fixture.interactions(s, d)),
    "feat_acceptance": lambda s, d: features.acceptance(fixture.interactions(s, d)),
    # The date as text: engines hand dates to Python in different types.
    "driver_features": lambda s, d: _rounded(
        feature_table(s, d), 4, "surge_reliance_score", "session_regularity"
    ).withColumn("signup_date", F.col("signup_date").cast("string")),
}

ORACLE = {
    "feat_earnings_per_hour": sql(
        """SELECT driver_id, coalesce(earned, 0) / nullif(online_seconds / 3600.0::DOUBLE, 0)
                  AS avg_earnings_per_hour_online
           FROM online LEFT JOIN rides USING (driver_id)""",
        "online",
        "rides",
    ),
    "feat_utilization": sql(
        """SELECT driver_id, least(coalesce(trip_seconds, 0)::DOUBLE / nullif(online_seconds, 0),
                                   1.0::DOUBLE) AS trip_utilization_rate
           FROM online LEFT JOIN rides USING (driver_id)""",
        "online",
        "rides",
    ),
    "feat_surge": sql(
        f"""SELECT driver_id, {rounded("premium_part / nullif(base_part, 0)", 4)}
                   AS surge_reliance_score FROM rides""",
        "rides",
    ),
    "feat_premium": sql(
        """SELECT driver_id,
                  CAST(regexp_matches(vehicle_dispatchability, 'premier|uberblack', 'i') AS INT)
                    AS is_premium_capable,
                  coalesce(n_premium::DOUBLE / nullif(n, 0), 0.0::DOUBLE) AS premium_trip_ratio
           FROM profiles LEFT JOIN rides USING (driver_id)""",
        "profiles",
        "rides",
    ),
    "feat_peak_hours": sql(
        """SELECT driver_id, n_peak::DOUBLE / nullif(n, 0) AS peak_hour_driver_score FROM rides""",
        "rides",
    ),
    "feat_regularity": sql(
        f"""SELECT driver_id, {rounded("session_regularity", 4)} AS session_regularity,
                   session_count FROM rhythm""",
        "rhythm",
    ),
    "feat_quest": sql(
        """SELECT driver_id, quests_done::DOUBLE / nullif(quests, 0) AS quest_completion_rate
           FROM offers""",
        "offers",
    ),
    "feat_incentive_reliance": sql(
        """SELECT driver_id, coalesce(bonus, 0)::DOUBLE AS total_bonus_earned,
                  coalesce(fares, 0)::DOUBLE AS total_fare_earned,
                  coalesce(tips, 0)::DOUBLE AS total_tip_earned,
                  coalesce(bonus, 0) / nullif(coalesce(bonus, 0) + coalesce(fares, 0)
                                              + coalesce(tips, 0), 0) AS incentive_reliance_pct
           FROM bonuses FULL JOIN rides USING (driver_id)""",
        "bonuses",
        "rides",
    ),
    "feat_tier_rank": sql(
        """SELECT driver_id, CASE current_tier WHEN 'Diamond' THEN 4 WHEN 'Platinum' THEN 3
                                               WHEN 'Gold' THEN 2 ELSE 1 END AS pro_tier_rank
           FROM profiles""",
        "profiles",
    ),
    "feat_cancellation": sql(
        """SELECT driver_id, bailed / nullif(yes + bailed, 0) AS cancellation_rate
           FROM reactions""",
        "reactions",
    ),
    "feat_acceptance": sql(
        """SELECT driver_id, yes / nullif(yes + no, 0) AS acceptance_rate FROM reactions""",
        "reactions",
    ),
    "driver_features": sql(
        f"""SELECT * REPLACE ({rounded("surge_reliance_score", 4)} AS surge_reliance_score,
                              {rounded("session_regularity", 4)} AS session_regularity,
                              CAST(signup_date AS VARCHAR) AS signup_date)
            FROM features""",
        "features",
    ),
}
