"""The training job: segments, clustered table, churn search, artefacts, run log."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetcohort.plans.churn import ChurnRun, train_churn
from fleetcohort.plans.segments import fit_segments
from fleetcohort.settings import CLUSTER_COUNT, CLUSTER_STARTS, SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_SPACE, SEED
from fleetcohort.sources.artefacts import save_models
from fleetcohort.sources.raw import open_required
from fleetcohort.sources.sinks import append_run_log, write_table


def run_training(
    spark: SparkSession,
    features_path: str,
    out: str,
    run_id: str,
    clusters: int = CLUSTER_COUNT,
    starts: int = CLUSTER_STARTS,
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    space: dict[str, list] = SEARCH_SPACE,
    seed: int = SEED,
) -> ChurnRun:
    """Read the feature table; write ``clustered``, ``models`` and one run to ``runs``."""
    features = open_required(spark, features_path)
    segments = fit_segments(features, clusters, starts, seed)
    write_table(segments.transform(features), f"{out}/clustered")
    clustered = open_required(spark, f"{out}/clustered")
    run = train_churn(clustered, draws, folds, space, seed)
    save_models(f"{out}/models", segments, run.model)
    append_run_log(spark, f"{out}/runs", run_id, run.params, run.metrics)
    return run
