"""A scored driver table that plain SQL can reproduce.

Fitted models cannot be checked value by value, so the campaign and report queries run
on drivers labelled by fixed anchors in standardised feature space and scored by a
fixed logistic formula over the same standardised features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.oracle_base import rounded
from catalog.tables import stored_features, written_once
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.operators.nearest import assign_nearest
from fleetcohort.plans import segments
from fleetcohort.settings import CLUSTERING_FEATURES, HIGH_RISK_FROM

Z = [f"z_{c}" for c in CLUSTERING_FEATURES]

# Anchors in the order of CLUSTERING_FEATURES.
ANCHORS = [
    (0, -0.5, -0.8, -0.3, -0.3, -0.8, 0.0),
    (1, 0.0, 0.0, -0.3, -0.3, 1.2, 0.0),
    (2, 0.0, 0.0, 0.0, 1.2, 0.0, 0.0),
    (3, 0.5, 0.5, 1.0, -0.3, 0.0, 0.0),
]
# Log-odds of churn: intercept, then one weight per clustering feature.
WEIGHTS = (0.3, -1.2, -0.8, 0.2, 0.1, -0.6, 0.4)
# The test tables' money runs in the tens of thousands per hour; bring it to dollars.
MONEY_UNIT = 4000.0


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "cluster_label int, " + ", ".join(f"{z} double" for z in Z))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    table = segments.standardised(stored_features(spark, folder))
    return assign_nearest(table, anchors(spark), "cluster_label", Z)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    table = labelled(spark, folder)
    odds = F.lit(WEIGHTS[0])
    for weight, z in zip(WEIGHTS[1:], Z):
        odds = odds + F.col(z) * weight
    personas = segments.persona_rules(segments.centroid_means(table))
    return (
        # One row per cluster.
        table.join(F.broadcast(personas), "cluster_label")
        .withColumn(
            "churn_probability",
            round_half_even(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), 4),
        )
        .withColumn("is_high_risk", F.col("churn_probability") >= HIGH_RISK_FROM)
        .withColumn(
            "avg_earnings_per_hour_online", F.col("avg_earnings_per_hour_online") / MONEY_UNIT
        )
        .drop(*Z)
    )


def unrounded(spark: SparkSession, folder: str) -> DataFrame:
    """Label and full-precision score of the same formula."""
    odds = F.lit(WEIGHTS[0])
    for weight, z in zip(WEIGHTS[1:], Z):
        odds = odds + F.col(z) * weight
    score = (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("score")
    return segments.standardised(stored_features(spark, folder)).select("Churned", score)


def scored_drivers(spark: SparkSession, folder: str) -> DataFrame:
    return written_once(spark, folder, "scored", _scored)


# --- the same in SQL ------------------------------------------------------------------

_STATS = ", ".join(
    f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}"
    for c in CLUSTERING_FEATURES
)
_Z_SQL = ", ".join(f"(coalesce({c}, 0) - m_{c}) / s_{c} AS z_{c}" for c in CLUSTERING_FEATURES)
DISTANCES = {
    a[0]: " + ".join(f"({z} - ({x}::DOUBLE)) * ({z} - ({x}::DOUBLE))" for z, x in zip(Z, a[1:]))
    for a in ANCHORS
}
_ODDS = f"{WEIGHTS[0]}::DOUBLE" + "".join(
    f" + {z} * ({w}::DOUBLE)" for w, z in zip(WEIGHTS[1:], Z)
)
_MEANS = ", ".join(f"avg(coalesce({c}, 0)) AS {c}" for c in CLUSTERING_FEATURES)

UNROUNDED_SQL = f'SELECT "Churned", 1 / (1 + exp(-({_ODDS}))) AS score FROM standard'

SCORED_SQL: dict[str, str] = {
    "standard": f"SELECT f.*, {_Z_SQL} FROM features f, (SELECT {_STATS} FROM features)",
    "labelled": "SELECT *, CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS cluster_label FROM "
    f"(SELECT *, [{', '.join(DISTANCES[i] for i in range(4))}] AS ds FROM standard)",
    "centroids": f"SELECT cluster_label, {_MEANS} FROM labelled GROUP BY cluster_label",
    "personas": """
        SELECT cluster_label,
               CASE WHEN premium_trip_ratio > 0.35 THEN 'Premium Specialist'
                    WHEN surge_reliance_score > (SELECT avg(surge_reliance_score) FROM centroids)
                         AND trip_utilization_rate > 0.40 THEN 'Pro-Optimizer'
                    WHEN quest_completion_rate > 0.50 THEN 'Quest Grinder'
                    ELSE 'Casual / At-Risk' END AS persona
        FROM centroids""",
    "scored": f"""
        SELECT * EXCLUDE (ds, {", ".join(Z)})
                 REPLACE (avg_earnings_per_hour_online / {MONEY_UNIT}::DOUBLE
                          AS avg_earnings_per_hour_online),
               {rounded(f"1 / (1 + exp(-({_ODDS})))", 4)} AS churn_probability,
               {rounded(f"1 / (1 + exp(-({_ODDS})))", 4)} >= 0.5 AS is_high_risk
        FROM labelled JOIN personas USING (cluster_label)""",
}
