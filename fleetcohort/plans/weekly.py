"""The weekly job: cohort, scores, arms, messages, outbox, operations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.plans import campaign, reports
from fleetcohort.plans.boosting import Ensemble
from fleetcohort.plans.cohort import weekly_cohort
from fleetcohort.plans.scoring import score_drivers
from fleetcohort.plans.segments import SegmentModel
from fleetcohort.settings import COHORT_SIZE, SEED
from fleetcohort.sources.raw import open_required
from fleetcohort.sources.sinks import append_dispatch_log, write_week
from fleetcohort.sources.staging import staged


def stored_week(spark: SparkSession, path: str, week: str) -> DataFrame:
    """One week of a stored table; the filter prunes all other partitions."""
    rows = open_required(spark, path).filter(F.col("week") == week)
    return rows.withColumn("week", F.col("week").cast("string"))


def run_week(
    spark: SparkSession,
    history: DataFrame,
    segments: SegmentModel,
    churn: Ensemble,
    out: str,
    week: str,
    n: int = COHORT_SIZE,
    seed: int | None = None,
    arm_seed: int = SEED,
) -> dict[str, DataFrame]:
    """Run one week and return its report tables.

    Tables under ``out``: weekly_cohort and scored_cohort (``week`` partitions, a re-run
    replaces its week), nudges and outbox (same) and dispatch_log (one batch a week, however often
    it is run). ``history`` is a
    stored feature table, with ``persona`` if the benchmarks should use it.
    """
    write_week(weekly_cohort(spark, history, week, n, seed), f"{out}/weekly_cohort")
    cohort = stored_week(spark, f"{out}/weekly_cohort", week)
    # Scored once; the campaign steps below read the staged copy.
    armed = campaign.assign_arms(score_drivers(cohort, segments, churn), seed=arm_seed)
    with staged(armed, "scored") as scored:
        messages = campaign.nudges(scored, campaign.benchmarks(history), week)
        write_week(messages.withColumn("week", F.lit(week)), f"{out}/nudges")
        written = stored_week(spark, f"{out}/nudges", week)
        write_week(campaign.outbox(written).withColumn("week", F.lit(week)), f"{out}/outbox")
        append_dispatch_log(stored_week(spark, f"{out}/outbox", week), f"{out}/dispatch_log", batch=week)
        write_week(campaign.mark_nudged(scored, written), f"{out}/scored_cohort")
    final = stored_week(spark, f"{out}/scored_cohort", week)
    return {
        "summary": campaign.run_summary(final),
        "kpis": reports.ops_kpis(final),
        "persona_breakdown": reports.persona_breakdown(final),
        "ab_test": reports.ab_test_sizes(final),
        "top_risk": reports.top_risk(final),
    }
