"""Segmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import kmeans_oracle
from catalog.oracle_base import rounded, sql
from catalog.scored import SCORED_SQL, Z, labelled
from catalog.tables import stored_features
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.plans import segments
from fleetcohort.plans.kmeans import ROUNDS
from fleetcohort.settings import CLUSTER_COUNT, CLUSTER_STARTS, CLUSTERING_FEATURES


def _rounded(df: DataFrame, places: int, columns: list[str]) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), places) for c in columns})


def _fitted_profile(s, d):
    features = stored_features(s, d)
    model = segments.fit_segments(features)
    profile = segments.cluster_profile(model.transform(features))
    personas = segments.persona_rules(segments.centroids_in_units(model.scale, model.centres))
    # One row per cluster.
    return _rounded(profile, 3, CLUSTERING_FEATURES).join(F.broadcast(personas), segments.LABEL)


def _elbow(s, d):
    return _rounded(segments.elbow(stored_features(s, d)), 6, ["training_cost"])


QUERIES = {
    "zscore_features": lambda s, d: _rounded(
        segments.standardised(stored_features(s, d)).select("driver_id", *Z), 6, Z
    ),
    "nearest_centroid": lambda s, d: labelled(s, d).select("driver_id", "cluster_label"),
    "persona_rules": lambda s, d: segments.persona_rules(
        segments.centroid_means(labelled(s, d))
    ),
    "cluster_sizes_means": lambda s, d: _rounded(
        segments.cluster_profile(labelled(s, d)), 3, CLUSTERING_FEATURES
    ),
    "kmeans_fit_profile": _fitted_profile,
    "elbow_table": _elbow,
}

ORACLE = {
    "zscore_features": sql(
        f"SELECT driver_id, {', '.join(f'{rounded(z, 6)} AS {z}' for z in Z)} FROM standard",
        "features",
        extra=SCORED_SQL,
    ),
    "nearest_centroid": sql(
        "SELECT driver_id, cluster_label FROM labelled", "features", extra=SCORED_SQL
    ),
    "persona_rules": sql("SELECT * FROM personas", "features", extra=SCORED_SQL),
    "cluster_sizes_means": sql(
        f"""SELECT cluster_label, count(*)::BIGINT AS drivers,
                   {", ".join(f"{rounded(f'avg({c})', 3)} AS {c}" for c in CLUSTERING_FEATURES)}
            FROM labelled GROUP BY cluster_label""",
        "features",
        extra=SCORED_SQL,
    ),
    "kmeans_fit_profile": sql(
        f"""SELECT c::INT AS cluster_label, count(*)::BIGINT AS drivers,
                   {", ".join(f"{rounded(f'avg({c})', 3)} AS {c}" for c in CLUSTERING_FEATURES)},
                   any_value(persona) AS persona
            FROM km_own JOIN km_best USING (k, start) JOIN features USING (driver_id) JOIN personas USING (c)
            GROUP BY c""",
        "features",
        extra={
            **kmeans_oracle.fits([CLUSTER_COUNT], CLUSTER_STARTS),
            "centroids": f"""SELECT c, {kmeans_oracle.centre_units()}
                             FROM km_at{ROUNDS} t JOIN km_best USING (k, start), km_scale""",
            "personas": SCORED_SQL["personas"].replace("cluster_label", "c"),
        },
        once=True,
    ),
    "elbow_table": sql(
        f"SELECT k, {rounded('cost', 6)} AS training_cost FROM km_best",
        "features",
        extra=kmeans_oracle.fits(list(range(2, 9)), CLUSTER_STARTS),
        once=True,
    ),
}
