"""Model artefacts: one folder per fitted model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from fleetcohort.plans.boosting import Ensemble
from fleetcohort.plans.segments import SegmentModel
from fleetcohort.sources.raw import MissingSource


def save_models(root: str, segments: SegmentModel, churn: Ensemble) -> None:
    """Each model as one row of text, and the ensemble's nodes as a table to look into."""
    spark = SparkSession.active()
    for name, model in (("segments", segments), ("churn", churn)):
        whole = spark.createDataFrame([(model.to_json(),)], "model string")
        whole.write.mode("overwrite").parquet(f"{root}/{name}")
    churn.node_table(spark).write.mode("overwrite").parquet(f"{root}/churn_nodes")


def _read(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    return row["model"] if row else None


def load_models(spark: SparkSession, root: str) -> tuple[SegmentModel, Ensemble]:
    """Both models, or an error naming what is missing. Personas are derived again."""
    found = {path: _read(spark, path) for path in (f"{root}/segments", f"{root}/churn")}
    missing = [path for path, text in found.items() if text is None]
    if missing:
        raise MissingSource(f"no model at {', '.join(missing)}; fit the models first")
    segments, churn = found.values()
    return SegmentModel.from_json(segments), Ensemble.from_json(churn)
