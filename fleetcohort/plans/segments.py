"""Driver segmentation: standardise, k-means, personas from centroid rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.functions.mapping import map_codes
from fleetcohort.functions.numeric import real
from fleetcohort.plans.kmeans import Scale, best_of, constant, fit_all, fit_scale, nearest
from fleetcohort.settings import (
    CASUAL,
    CLUSTER_COUNT,
    CLUSTER_STARTS,
    CLUSTERING_FEATURES,
    PREMIUM,
    PREMIUM_RATIO_ABOVE,
    PRO,
    PRO_UTILIZATION_ABOVE,
    QUEST,
    QUEST_RATE_ABOVE,
    SEED,
)
from fleetcohort.sources.raw import require_columns

LABEL = "cluster_label"


def filled(column: str) -> Column:
    return F.coalesce(real(F.col(column)), F.lit(0.0))


def standardised(df: DataFrame, columns: list[str] = CLUSTERING_FEATURES) -> DataFrame:
    """Adds ``z_<column>``: missing as 0, centred, divided by the population deviation."""
    stats = df.select(
        F.struct(
            *[F.avg(filled(c)).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(filled(c)).alias(f"std_{c}") for c in columns],
        )
    ).scalar()
    with_stats = df.withColumn("_stats", stats)
    z = {
        f"z_{c}": (filled(c) - F.col("_stats")[f"mean_{c}"])
        / F.nullif(F.col("_stats")[f"std_{c}"], F.lit(0.0))
        for c in columns
    }
    return with_stats.withColumns(z).drop("_stats")


# --- personas -------------------------------------------------------------------


def centroid_means(labelled: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean of every clustering feature per cluster, missing values as 0."""
    return labelled.groupBy(label).agg(*[F.avg(filled(c)).alias(c) for c in CLUSTERING_FEATURES])


def persona_rules(centroids: DataFrame, label: str = LABEL) -> DataFrame:
    """Persona of each centroid in original units. Two clusters may share a persona."""
    surge = F.col("surge_reliance_score")
    mean_surge = centroids.select(F.avg("surge_reliance_score")).scalar()
    persona = (
        F.when(F.col("premium_trip_ratio") > PREMIUM_RATIO_ABOVE, PREMIUM)
        .when((surge > mean_surge) & (F.col("trip_utilization_rate") > PRO_UTILIZATION_ABOVE), PRO)
        .when(F.col("quest_completion_rate") > QUEST_RATE_ABOVE, QUEST)
        .otherwise(CASUAL)
    )
    return centroids.select(label, persona.alias("persona"))


def cluster_profile(labelled: DataFrame, label: str = LABEL) -> DataFrame:
    """Size and mean feature values per cluster; NULLs do not enter a mean."""
    return labelled.groupBy(label).agg(
        F.count(F.lit(1)).alias("drivers"), *[F.avg(c).alias(c) for c in CLUSTERING_FEATURES]
    )


# --- fitted model -----------------------------------------------------------------


@dataclass(frozen=True)
class SegmentModel:
    """Scale and centres, plus the persona of each cluster."""

    scale: Scale
    centres: list[list[int]]
    personas: dict[int, str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster_label`` and ``persona``."""
        require_columns(df, CLUSTERING_FEATURES)
        label = F.expr(f"{nearest(constant(self.centres, 'array<array<bigint>>'))}.c")
        labelled = df.withColumn("_v", self.scale.vector()).withColumn(LABEL, label).drop("_v")
        return labelled.withColumn("persona", map_codes(F.col(LABEL), self.personas))

    def to_json(self) -> str:
        return json.dumps({"scale": asdict(self.scale), "centres": self.centres})

    @classmethod
    def from_json(cls, text: str) -> SegmentModel:
        parts = json.loads(text)
        return with_personas(Scale(**parts["scale"]), parts["centres"])


def centroids_in_units(scale: Scale, centres: list[list[int]]) -> DataFrame:
    """Cluster centres back in original units: k rows."""
    rows = [(label, *scale.in_units(centre)) for label, centre in enumerate(centres)]
    schema = f"{LABEL} int, " + ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)
    return SparkSession.active().createDataFrame(rows, schema)


def with_personas(scale: Scale, centres: list[list[int]]) -> SegmentModel:
    """Personas are derived from the centroids each time: cluster numbers carry no meaning."""
    named = persona_rules(centroids_in_units(scale, centres)).collect()  # k rows
    return SegmentModel(scale, centres, {row[LABEL]: row["persona"] for row in named})


def fit_segments(
    features: DataFrame, k: int = CLUSTER_COUNT, starts: int = CLUSTER_STARTS, seed: int = SEED
) -> SegmentModel:
    """Best of several k-means starts. Pass a stored feature table: it is read repeatedly."""
    scale = fit_scale(features, CLUSTERING_FEATURES)
    return with_personas(scale, best_of(fit_all(features, scale, [k], starts, seed)).centres)


def elbow(
    features: DataFrame, ks: range = range(2, 9), starts: int = CLUSTER_STARTS, seed: int = SEED
) -> DataFrame:
    """Training cost of the best start per number of clusters."""
    scale = fit_scale(features, CLUSTERING_FEATURES)
    fits = fit_all(features, scale, list(ks), starts, seed)
    costs = [(k, best_of([f for f in fits if f.k == k]).cost) for k in ks]
    return features.sparkSession.createDataFrame(costs, "k int, training_cost double")
