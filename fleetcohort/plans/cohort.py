"""Synthetic weekly cohort calibrated on the feature history.

Every value is a function of (seed, column, row id), so a cohort does not depend on
partitioning and a lost executor recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import digest, draw, exponential, standard_normal
from fleetcohort.functions.numeric import clip, round_half_even
from fleetcohort.settings import (
    CALIBRATED_FEATURES,
    COHORT_COLUMNS,
    COHORT_SIZE,
    COHORT_TIER_WEIGHTS,
)

ROW = "row_id"

# Drawn from a normal fitted on the history and clipped to [0, 1].
_NORMAL = [
    "trip_utilization_rate",
    "surge_reliance_score",
    "quest_completion_rate",
    "cancellation_rate",
    "acceptance_rate",
    "peak_hour_driver_score",
    "incentive_reliance_pct",
]


def calibration(history: DataFrame) -> DataFrame:
    """One row: mean, sample deviation, minimum and maximum of each present feature."""
    columns = [c for c in CALIBRATED_FEATURES if c in history.columns]
    return history.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )


def _weighted_choice(u: Column, weights: dict[int, float]) -> Column:
    choices = list(weights.items())
    edge, picked = 0.0, None
    for value, weight in choices[:-1]:
        edge += weight
        hit = u < F.lit(round(edge, 10))
        picked = F.when(hit, value) if picked is None else picked.when(hit, value)
    return picked.otherwise(choices[-1][0])


def synthesize(row_ids: DataFrame, history: DataFrame, week: str, seed: int) -> DataFrame:
    """One synthetic driver per ``row_id``, 17 columns, stamped with ``week`` (ISO date)."""
    stats = calibration(history)
    packed = stats.select(F.struct(*[F.col(c) for c in stats.columns])).scalar()
    key = F.col(ROW)

    def z(stream: str) -> Column:
        return standard_normal(seed, stream, key).alias(f"z_{stream}")

    # First the draws, each a column of its own, then the values built on them.
    draws = row_ids.select(
        packed.alias("stats"),
        digest(seed, "driver", key).alias("hex"),
        *[z(c) for c in _NORMAL],
        z("earnings"),
        z("specialist_ratio"),
        z("rating"),
        exponential(seed, "ordinary_ratio", key, 0.04).alias("e_ordinary"),
        exponential(seed, "regularity", key, 40.0).alias("e_regularity"),
        draw(seed, "is_specialist", key).alias("u_specialist"),
        draw(seed, "tier", key).alias("u_tier"),
        draw(seed, "sessions", key).alias("u_sessions"),
    )
    values = draws.select(
        F.expr(
            "concat_ws('-', substr(hex, 1, 8), substr(hex, 9, 4), substr(hex, 13, 4), "
            "substr(hex, 17, 4), substr(hex, 21, 12))"
        ).alias("driver_id"),
        F.expr("z_rating * 0.15D + 4.75D").alias("rating"),
        # Two kinds of drivers: some live on premium trips, most hardly take any.
        F.when(F.col("u_specialist") < 0.15, clip(F.expr("z_specialist_ratio * 0.12D + 0.75D"), 0.4, 1.0))
        .otherwise(clip(F.col("e_ordinary"), 0.0, 0.35))
        .alias("premium"),
        F.expr("exp(ln(stats.avg_earnings_per_hour_online.mean) + z_earnings * 0.5D)").alias("earnings"),
        *[F.expr(f"stats.{c}.mean + stats.{c}.std * z_{c}").alias(c) for c in _NORMAL],
        "e_regularity",
        _weighted_choice(F.col("u_tier"), COHORT_TIER_WEIGHTS).alias("pro_tier_rank"),
        F.expr("CAST(floor(u_sessions * 199) + 1 AS INT)").alias("session_count"),
    )

    def bounded(column: str, low: float, high: float, places: int, name: str) -> Column:
        return round_half_even(clip(F.col(column), low, high), places).alias(name)

    return values.select(
        "driver_id",
        F.lit(week).alias("signup_date"),
        bounded("rating", 4.0, 5.0, 2, "avg_rating"),
        F.expr("IF(premium > 0.3D, 1, 0)").alias("is_premium_capable"),
        "pro_tier_rank",
        bounded("earnings", 3.0, 80.0, 4, "avg_earnings_per_hour_online"),
        round_half_even(F.col("premium"), 4).alias("premium_trip_ratio"),
        *[bounded(c, 0.0, 1.0, 4, c) for c in _NORMAL],
        bounded("e_regularity", 0.0, 300.0, 2, "session_regularity"),
        "session_count",
        F.lit(week).alias("week"),
    ).select(*COHORT_COLUMNS)


def weekly_cohort(
    spark: SparkSession, history: DataFrame, week: str, n: int = COHORT_SIZE, seed: int | None = None
) -> DataFrame:
    """``n`` synthetic drivers; without a seed the week itself seeds the draws."""
    if seed is None:
        seed = int(week.replace("-", ""))
    return synthesize(spark.range(n).withColumnRenamed("id", ROW), history, week, seed)
