"""Re-engagement campaign: arms, benchmarks, message choice, outbox, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import in_share
from fleetcohort.functions.mapping import map_codes
from fleetcohort.functions.numeric import real, round_half_even, truncated_percent
from fleetcohort.functions.text import fixed_text, money_text, percent_text
from fleetcohort.operators.membership import with_membership
from fleetcohort.operators.quantiles import exact_quantiles
from fleetcohort.operators.reshape import melt
from fleetcohort.settings import (
    CASUAL,
    FALLBACK_BENCHMARKS,
    HIGH_CANCEL_ABOVE,
    LOW_EARNINGS_BELOW,
    MISSING_CANCEL,
    MISSING_EARNINGS,
    NUDGE_SHARE,
    PREMIUM,
    PRO,
    QUEST,
    SEED,
    TIER_NAMES,
    TIER_THRESHOLDS,
)

EARNINGS = "avg_earnings_per_hour_online"
UTILIZATION = "trip_utilization_rate"
CANCEL = "cancellation_rate"


PERSONA_COUNTS = {
    "casual_count": CASUAL,
    "quest_count": QUEST,
    "premium_count": PREMIUM,
    "pro_count": PRO,
}


# --- arms -----------------------------------------------------------------------


def in_campaign() -> Column:
    return (F.col("persona") == CASUAL) & F.col("is_high_risk")


def assign_arms(scored: DataFrame, share: float = NUDGE_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``ab_group``. A driver keeps its arm in every run; NULL outside the campaign."""
    arm = F.when(in_share(seed, "arm", F.col("driver_id"), share), "nudge").otherwise("control")
    return scored.withColumn("ab_group", F.when(in_campaign(), arm))


def with_arm_column(scored: DataFrame) -> DataFrame:
    """Without an arm column every driver counts as nudge."""
    if "ab_group" in scored.columns:
        return scored
    return scored.withColumn("ab_group", F.lit("nudge"))


def targets(scored: DataFrame) -> DataFrame:
    return with_arm_column(scored).filter(in_campaign() & (F.col("ab_group") == "nudge"))


def arm_sizes(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("ab_group") == "nudge").alias("nudge_group_size"),
        F.count_if(F.col("ab_group") == "control").alias("control_group_size"),
    )


def lift(outcomes: DataFrame, retained: str, needed: float = 0.05) -> DataFrame:
    """Retention per arm and the difference; the campaign scales from ``needed`` on."""
    kept = F.col(retained).cast("double")
    rates = outcomes.filter(F.col("ab_group").isNotNull()).agg(
        F.avg(F.when(F.col("ab_group") == "nudge", kept)).alias("nudge_retention"),
        F.avg(F.when(F.col("ab_group") == "control", kept)).alias("control_retention"),
    )
    gain = F.col("nudge_retention") - F.col("control_retention")
    return rates.withColumn("lift", gain).withColumn("scale_up", F.col("lift") >= needed)


# --- benchmarks ----------------------------------------------------------------


def top_earners(history: DataFrame) -> DataFrame:
    """Pro-Optimizer drivers, or the top quarter by earnings when there are none.

    Whether there are any is looked up first (one matching row ends that scan), so the quartile
    is computed only where it decides.
    """
    if "persona" in history.columns:
        pros = history.filter(F.col("persona") == PRO)
        if not pros.isEmpty():
            return pros
    quarter = exact_quantiles(history, [], EARNINGS, {"q3": 0.75})
    return history.filter(F.col(EARNINGS) >= quarter.scalar())


def benchmarks(history: DataFrame) -> DataFrame:
    """One row of exact medians; constants where the history has no value.

    ``history`` is read several times; pass a stored table.
    """
    rows = melt(top_earners(history), [], [EARNINGS, UTILIZATION, CANCEL], "metric", "value")
    medians = exact_quantiles(rows, ["metric"], "value", {"median": 0.5})

    def pick(metric: str, factor: int, places: int, name: str) -> Column:
        median = F.max(F.when(F.col("metric") == metric, F.col("median")))
        value = round_half_even(median * factor, places)
        return F.coalesce(value, F.lit(FALLBACK_BENCHMARKS[name])).alias(name)

    return medians.agg(
        pick(EARNINGS, 1, 2, "pro_epho_median"),
        pick(UTILIZATION, 100, 1, "pro_util_median"),
        pick(CANCEL, 100, 1, "pro_cancel_median"),
    )


# --- message ---------------------------------------------------------------------


def variant() -> Column:
    """Weakest signal first; a missing signal never selects its variant."""
    earnings = F.coalesce(real(F.col(EARNINGS)), F.lit(MISSING_EARNINGS))
    cancel = F.coalesce(real(F.col(CANCEL)), F.lit(MISSING_CANCEL))
    return (
        F.when(earnings < LOW_EARNINGS_BELOW, "LOW_EARNINGS")
        .when(cancel > HIGH_CANCEL_ABOVE, "HIGH_CANCEL")
        .otherwise("GOAL_GRADIENT")
    )


def with_tier_progress(df: DataFrame) -> DataFrame:
    """Adds tier, next tier, trips remaining and whole percent towards it.

    Sessions stand in for lifetime trips. The top tier has no next tier; trips
    remaining go negative past the threshold while the percent stops at 100.
    """
    top = max(TIER_NAMES)
    needed = {r: TIER_THRESHOLDS[r + 1] - TIER_THRESHOLDS[r] for r in TIER_NAMES if r < top}
    rank = F.coalesce(F.col("pro_tier_rank").cast("int"), F.lit(1))
    count = F.coalesce(F.col("session_count").cast("bigint"), F.lit(10))
    done = F.greatest(F.lit(0), count - map_codes(rank, TIER_THRESHOLDS))
    span = map_codes(rank, needed)
    return df.withColumns(
        {
            "tier": map_codes(rank, TIER_NAMES),
            "next_tier": map_codes(rank, {r: TIER_NAMES[r + 1] for r in needed}),
            "trips_remaining": F.when(span.isNotNull(), span - done),
            "tier_percent": truncated_percent(done.cast("double") / span),
        }
    )


def _progress_text() -> Column:
    line = F.concat(
        F.lit("From "),
        F.col("tier"),
        F.lit(" to "),
        F.col("next_tier"),
        F.lit(": "),
        F.col("tier_percent").cast("string"),
        F.lit("% done, "),
        F.col("trips_remaining").cast("string"),
        F.lit(" trips left."),
    )
    return F.coalesce(line, F.lit("You hold the highest tier."))


def _paragraphs(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def render(df: DataFrame) -> DataFrame:
    """Adds subject and body; expects variant, tier progress and benchmark columns."""
    earnings = F.coalesce(F.col(EARNINGS), F.lit(0.0))
    cancel = F.coalesce(F.col(CANCEL), F.lit(0.0))
    use = F.coalesce(F.col(UTILIZATION), F.lit(0.0))
    quests = F.coalesce(F.col("quest_completion_rate"), F.lit(0.0))
    bench = F.col("pro_epho_median")
    # The gap is the difference of the two printed amounts.
    gap = bench - round_half_even(earnings, 2)
    hello = F.concat(F.lit("Week of "), F.date_format(F.col("run_date"), "yyyy-MM-dd"), F.lit("."))
    low_subject = F.concat(
        F.lit("Hourly earnings: you "), money_text(earnings), F.lit(", top drivers "), money_text(bench)
    )
    low_body = _paragraphs(
        hello,
        F.concat(
            F.lit("An online hour brings you "),
            money_text(earnings),
            F.lit("; the best-earning drivers make "),
            money_text(bench),
            F.lit(", a difference of "),
            money_text(gap),
            F.lit("."),
        ),
        F.concat(
            F.lit("You spend "),
            percent_text(use),
            F.lit(" of your online time on trips, they spend "),
            fixed_text(F.col("pro_util_median"), 1),
            F.lit("%. You complete "),
            percent_text(quests),
            F.lit(" of the Quests you are offered."),
        ),
        F.lit("Start near demand before the rush, follow surge areas and finish open Quests."),
        _progress_text(),
    )
    cancel_subject = F.lit("Fewer cancellations keep your tier benefits safe")
    cancel_body = _paragraphs(
        hello,
        F.concat(
            F.lit("You cancel "),
            percent_text(cancel),
            F.lit(" of the trips you accept; the best-earning drivers cancel "),
            fixed_text(F.col("pro_cancel_median"), 1),
            F.lit("%."),
        ),
        F.lit("Look at the destination first and turn down a trip before accepting it, not after."),
        _progress_text(),
    )
    goal = F.coalesce(F.col("next_tier"), F.lit(TIER_NAMES[max(TIER_NAMES)]))
    goal_subject = F.concat(F.lit("Your way to "), goal)
    goal_body = _paragraphs(
        hello,
        F.concat(F.lit("Your tier today is "), F.col("tier"), F.lit(". "), _progress_text()),
        F.concat(
            F.lit("Drivers ahead of you make "),
            money_text(bench),
            F.lit(" an hour, you make "),
            money_text(earnings),
            F.lit("."),
        ),
        F.concat(
            F.lit("Peak hours, open Quests and fewer cancellations (now "),
            percent_text(cancel),
            F.lit(") get you there."),
        ),
    )
    kind = F.col("variant")

    def choose(low: Column, high: Column, other: Column) -> Column:
        return F.when(kind == "LOW_EARNINGS", low).when(kind == "HIGH_CANCEL", high).otherwise(other)

    return df.withColumns(
        {
            "subject": choose(low_subject, cancel_subject, goal_subject),
            "body": choose(low_body, cancel_body, goal_body),
        }
    )


def nudges(scored: DataFrame, bench: DataFrame, run_date: str) -> DataFrame:
    """One message per targeted driver: driver_id, variant, subject, body, generated_at."""
    names = list(FALLBACK_BENCHMARKS)
    packed = bench.select(F.struct(*names)).scalar()
    chosen = with_tier_progress(targets(scored)).withColumns(
        {"variant": variant(), "_bench": packed, "run_date": F.to_date(F.lit(run_date))}
    )
    ready = chosen.select("*", *[F.col("_bench")[n].alias(n) for n in names])
    return render(ready).select(
        "driver_id", "variant", "subject", "body", F.col("run_date").alias("generated_at")
    )


# --- outbox ----------------------------------------------------------------------------


def outbox(messages: DataFrame, domain: str = "drivers.example") -> DataFrame:
    """Dispatch rows, one per driver. Nothing is sent from here, so every row is ``skipped``."""
    return messages.select(
        "driver_id",
        F.concat(F.col("driver_id").cast("string"), F.lit(f"@{domain}")).alias("recipient"),
        "subject",
        F.concat(F.lit("nudge:"), "variant").alias("type"),
        F.lit("skipped").alias("status"),
        F.lit("").alias("error"),
    )


def mark_nudged(scored: DataFrame, messages: DataFrame) -> DataFrame:
    """``nudge_sent`` says a message was generated, not that it was delivered."""
    return with_membership(scored, messages, "driver_id", "nudge_sent")


def run_summary(scored: DataFrame) -> DataFrame:
    """One row with the counts of a run; expects arms and ``nudge_sent``."""
    return scored.agg(
        F.count(F.lit(1)).alias("cohort_size"),
        F.count_if("is_high_risk").alias("high_risk_count"),
        F.count_if(F.col("ab_group") == "nudge").alias("nudge_group_size"),
        F.count_if(F.col("ab_group") == "control").alias("control_group_size"),
        F.count_if("nudge_sent").alias("nudges_generated"),
        *[
            F.count_if(F.col("persona") == persona).alias(name)
            for name, persona in PERSONA_COUNTS.items()
        ],
    )
