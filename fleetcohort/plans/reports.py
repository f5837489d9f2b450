"""Business-report and weekly operations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcohort.functions.mapping import map_codes
from fleetcohort.functions.numeric import cents, safe_ratio, scale_min_max
from fleetcohort.functions.text import percent_text, short_id
from fleetcohort.settings import (
    CASUAL,
    EARNINGS_COMPONENTS,
    EARNINGS_PERSONAS,
    FINGERPRINT_METRICS,
    MATURITY_METRICS,
    MATURITY_PERSONAS,
    TOP_RISK_ROWS,
)
from fleetcohort.sources.raw import RawLogs, absent_logs


def fingerprint(
    segmented: DataFrame, by: str = "persona", metrics: dict[str, str] = FINGERPRINT_METRICS
) -> DataFrame:
    """Mean of each metric per segment, placed between the metric's overall minimum and
    maximum. One pass: the extremes come from the per-segment extremes."""
    names = list(metrics)
    per_segment = segmented.groupBy(by).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in names],
        *[F.min(m).cast("double").alias(f"min_{m}") for m in names],
        *[F.max(m).cast("double").alias(f"max_{m}") for m in names],
    )
    overall = per_segment.select(
        F.struct(
            *[F.min(f"min_{m}").alias(f"min_{m}") for m in names],
            *[F.max(f"max_{m}").alias(f"max_{m}") for m in names],
        )
    ).scalar()
    scaled = per_segment.withColumn("_all", overall).select(
        by,
        *[
            scale_min_max(
                F.col(f"avg_{m}"), F.col("_all")[f"min_{m}"], F.col("_all")[f"max_{m}"]
            ).alias(m)
            for m in names
        ],
    )
    long = scaled.unpivot([by], names, "metric", "score")
    return long.withColumn("metric", map_codes(F.col("metric"), metrics))


def maturity_gap(segmented: DataFrame) -> DataFrame:
    """Mean score per (persona, metric) for three personas; earnings relative to their best."""
    chosen = segmented.filter(F.col("persona").isin(list(MATURITY_PERSONAS)))
    earnings = "avg_earnings_per_hour_online"
    means = chosen.groupBy("persona").agg(
        *[F.avg(m).alias(m) for m in MATURITY_METRICS], F.max(earnings).alias("best")
    )
    top = means.select(F.max("best")).scalar()
    scaled = means.withColumn(earnings, safe_ratio(F.col(earnings), top)).drop("best")
    long = scaled.unpivot(["persona"], list(MATURITY_METRICS), "metric", "score")
    return long.select(
        map_codes(F.col("persona"), MATURITY_PERSONAS).alias("persona"),
        map_codes(F.col("metric"), MATURITY_METRICS).alias("metric"),
        "score",
    )


def driver_earnings(segmented: DataFrame, logs: RawLogs) -> DataFrame:
    """Organic and incentive money per driver, 0 where a side is missing."""
    organic = logs.trips.groupBy("driver_id").agg(
        F.sum(cents(F.col("fare")) + cents(F.col("tip"))).alias("organic")
    )
    bonus = (
        logs.incentives.filter(F.col("status") == "completed")
        .groupBy("driver_id")
        .agg(F.sum(cents(F.col("bonus_amount"))).alias("bonus"))
    )
    return (
        segmented.select("driver_id", "persona")
        .join(organic, "driver_id", "left")
        .join(bonus, "driver_id", "left")
        .na.fill(0, ["organic", "bonus"])
    )


def earnings_composition(segmented: DataFrame, logs: RawLogs) -> DataFrame:
    """Mean over drivers of the organic and incentive percentage, per persona.

    A driver without earnings has no percentage and does not enter the mean. Without one of its
    logs the report has the same rows, no percentages, and a note that names the log.
    """
    names = list(EARNINGS_COMPONENTS)
    absent = absent_logs(logs, "trips", "incentives")
    if absent:
        rows = [(p, EARNINGS_COMPONENTS[n], None, f"unavailable: no {' and '.join(absent)}") for p in EARNINGS_PERSONAS for n in names]
        return segmented.sparkSession.createDataFrame(rows, "persona string, component string, pct double, note string")
    chosen = segmented.filter(F.col("persona").isin(EARNINGS_PERSONAS))
    total = F.col("organic") + F.col("bonus")
    shares = driver_earnings(chosen, logs).select(
        "persona",
        (safe_ratio(F.col("organic"), total) * 100).alias("pct_organic"),
        (safe_ratio(F.col("bonus"), total) * 100).alias("pct_incentive"),
    )
    means = shares.groupBy("persona").agg(*[F.avg(n).alias(n) for n in names])
    long = means.unpivot(["persona"], names, "component", "pct")
    named = long.withColumn("component", map_codes(F.col("component"), EARNINGS_COMPONENTS))
    return named.withColumn("note", F.lit(None).cast("string"))


def churn_by_persona(segmented: DataFrame) -> DataFrame:
    rates = segmented.groupBy("persona").agg(F.avg("Churned").alias("churn_rate"))
    return rates.orderBy(F.desc("churn_rate"), "persona")


def persona_summary(segmented: DataFrame) -> DataFrame:
    summary = segmented.groupBy("persona").agg(
        F.count(F.lit(1)).alias("drivers"), F.avg("Churned").alias("churn_rate")
    )
    return summary.withColumn("churn_label", percent_text(F.col("churn_rate")))


def executive_kpis(segmented: DataFrame) -> DataFrame:
    casual = F.when(F.col("persona") == CASUAL, F.col("Churned"))
    return segmented.agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.avg("Churned").alias("churn_rate"),
        F.avg(casual).alias("at_risk_churn_rate"),
    )


# --- weekly operations ------------------------------------------------------------------


def ops_kpis(scored: DataFrame) -> DataFrame:
    sent = F.count_if("nudge_sent") if "nudge_sent" in scored.columns else F.lit(0).cast("bigint")
    return scored.agg(
        F.count(F.lit(1)).alias("drivers_scored"),
        F.count_if("is_high_risk").alias("high_risk"),
        F.count_if(F.col("persona") == CASUAL).alias("casual"),
        sent.alias("nudges_sent"),
    )


def persona_breakdown(scored: DataFrame) -> DataFrame:
    rows = scored.groupBy("persona").agg(
        F.count("driver_id").alias("drivers"),
        F.avg("churn_probability").alias("mean_churn"),
        F.count_if("is_high_risk").alias("high_risk"),
    )
    return rows.orderBy(F.desc("mean_churn"), "persona")


def ab_test_sizes(scored: DataFrame) -> DataFrame | None:
    """Arm sizes within the casual persona; None when no arms were assigned."""
    if "ab_group" not in scored.columns:
        return None
    casual = scored.filter(F.col("persona") == CASUAL)
    return casual.agg(
        F.count_if(F.col("ab_group") == "nudge").alias("nudge"),
        F.count_if(F.col("ab_group") == "control").alias("control"),
    )


def top_risk(scored: DataFrame, n: int = TOP_RISK_ROWS) -> DataFrame:
    """The n flagged drivers with the highest probability, ties by id."""
    ranked = scored.filter("is_high_risk").orderBy(F.desc("churn_probability"), "driver_id").limit(n)
    return ranked.select(
        "driver_id",
        F.concat(short_id(F.col("driver_id")), F.lit("…")).alias("short_id"),
        "persona",
        "churn_probability",
        percent_text(F.col("churn_probability")).alias("risk_label"),
    )


def by_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("churn_probability"), "driver_id")


def driver_record(scored: DataFrame, driver_id) -> DataFrame:
    """One driver's row; the equality reaches the scan as a pushed filter."""
    return scored.filter(F.col("driver_id") == driver_id)
