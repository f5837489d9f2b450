"""Cohort scoring: persona, churn probability, high-risk flag."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetcohort.plans.boosting import Ensemble
from fleetcohort.plans.churn import flag_high_risk, predict
from fleetcohort.plans.segments import SegmentModel
from fleetcohort.settings import CHURN_NUMERIC_FEATURES
from fleetcohort.sources.raw import require_columns


def score_drivers(drivers: DataFrame, segments: SegmentModel, churn: Ensemble) -> DataFrame:
    """Adds cluster_label, persona, churn_probability and is_high_risk.

    The same path serves a weekly cohort and a table of what-if scenarios.
    """
    require_columns(drivers, CHURN_NUMERIC_FEATURES)
    return flag_high_risk(predict(segments.transform(drivers), churn)).drop("churn_prediction")
