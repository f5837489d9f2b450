"""Campaign, cohort, scoring and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.oracle_base import rounded, sql
from catalog.quality_queries import BOX_COLUMNS, BY_LABEL, box_sql
from catalog.scored import SCORED_SQL, scored_drivers
from catalog.tables import stored_features
from fleetcohort.functions.mapping import risk_band
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.functions.text import title_label
from fleetcohort.plans import campaign, cohort, profile, reports
from fleetcohort.settings import CALIBRATED_FEATURES, CLUSTERING_FEATURES, COHORT_COLUMNS
from fleetcohort.sources import fixture
from fleetcohort.sources.sinks import append_dispatch_log, read_dispatch_log, write_by_key
from fleetcohort.sources.staging import staging_root

WEEK = "2024-06-03"
CLUSTER_METRICS = {c: c for c in CLUSTERING_FEATURES}
SEED = 42


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), places) for c in columns})


def _armed(s, d):
    return campaign.assign_arms(scored_drivers(s, d))


def _messages(s, d):
    scored = scored_drivers(s, d)
    return campaign.nudges(campaign.assign_arms(scored), campaign.benchmarks(scored), WEEK)


def _marked(s, d):
    return campaign.mark_nudged(_armed(s, d), _messages(s, d))


def _dispatch_log(s, d):
    """The stored log, newest first: outbox rows through the writer and the reader, each stamped
    with the driver's signup day."""
    days = scored_drivers(s, d).select("driver_id", F.col("signup_date").cast("timestamp").alias("day"))
    path = f"{staging_root(s)}/fleetcohort/{s.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    rows = campaign.outbox(_messages(s, d)).join(days, "driver_id")
    append_dispatch_log(rows, path, stamp=F.col("day"))
    return read_dispatch_log(s, path).withColumn("timestamp", F.col("timestamp").cast("string"))


def _record(s, d):
    """One driver (the last by id) out of the scored table as it is stored for look-ups."""
    columns = ["driver_id", "persona", "churn_probability", "is_high_risk"]
    scored = scored_drivers(s, d).select(columns)
    path = f"{staging_root(s)}/fleetcohort/{s.sparkContext.applicationId}/lookup-{uuid.uuid4().hex}"
    write_by_key(scored, path, "driver_id")
    wanted = scored.agg(F.max("driver_id")).first()[0]
    return reports.driver_record(s.read.schema(scored.schema).parquet(path), wanted)


def _cohort(s, d):
    ids = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("row_id"))
    return cohort.synthesize(ids, stored_features(s, d), WEEK, SEED)


def _calibration(s, d):
    stats = cohort.calibration(stored_features(s, d))
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}.*")) for c in CALIBRATED_FEATURES]
    long = stats.select(F.inline(F.array(*entries)))
    return _rounded(long, 3, "mean", "std", "min", "max")


def _labels(s, d):
    types = fixture.trips(s, d).groupBy("trip_type").agg(F.count(F.lit(1)).alias("n"))
    events = fixture.interactions(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    both = types.select(F.col("trip_type").alias("code"), "n").unionAll(
        events.select(F.col("event_type").alias("code"), "n")
    )
    return both.withColumn("label", title_label(F.col("code")))


def _lift(s, d):
    outcomes = _armed(s, d).withColumn("retained", 1 - F.col("Churned"))
    return _rounded(campaign.lift(outcomes, "retained"), 6, "nudge_retention", "control_retention", "lift")


QUERIES = {
    "risk_band": lambda s, d: scored_drivers(s, d).select(
        "driver_id", "churn_probability", risk_band(F.col("churn_probability")).alias("band")
    ),
    "ab_assignment": lambda s, d: _armed(s, d).select("driver_id", "ab_group"),
    "ab_group_sizes": lambda s, d: campaign.arm_sizes(_armed(s, d)),
    "campaign_targets": lambda s, d: campaign.targets(_armed(s, d)).select("driver_id", "persona"),
    "lift_evaluation": _lift,
    "benchmarks_median": lambda s, d: campaign.benchmarks(scored_drivers(s, d)),
    "benchmarks_quartile": lambda s, d: campaign.benchmarks(scored_drivers(s, d).drop("persona")),
    "variant_select": lambda s, d: scored_drivers(s, d).select(
        "driver_id", campaign.variant().alias("variant")
    ),
    "tier_progress": lambda s, d: campaign.with_tier_progress(scored_drivers(s, d)).select(
        "driver_id", "tier", "next_tier", "trips_remaining", "tier_percent"
    ),
    "nudge_messages": lambda s, d: _messages(s, d).withColumn(
        "generated_at", F.col("generated_at").cast("string")
    ),
    "outbox_rows": lambda s, d: campaign.outbox(_messages(s, d)),
    "nudge_sent_flag": lambda s, d: _marked(s, d).select("driver_id", "nudge_sent"),
    "run_summary": lambda s, d: campaign.run_summary(_marked(s, d)),
    "dispatch_log_newest": _dispatch_log,
    "driver_record": _record,
    "cohort_calibration": _calibration,
    "cohort_synthetic": _cohort,
    "label_titles": _labels,
    "fingerprint_long": lambda s, d: _rounded(reports.fingerprint(scored_drivers(s, d)), 6, "score"),
    "fingerprint_clusters": lambda s, d: _rounded(
        reports.fingerprint(scored_drivers(s, d), "cluster_label", CLUSTER_METRICS), 6, "score"
    ),
    "maturity_gap": lambda s, d: _rounded(reports.maturity_gap(scored_drivers(s, d)), 6, "score"),
    "earnings_composition": lambda s, d: _rounded(
        reports.earnings_composition(scored_drivers(s, d), fixture.raw_logs(s, d)), 6, "pct"
    ),
    "box_stats_by_persona": lambda s, d: _rounded(
        profile.box_stats(scored_drivers(s, d), BY_LABEL, "persona"), 6, *BOX_COLUMNS
    ),
    "churn_by_persona": lambda s, d: reports.churn_by_persona(scored_drivers(s, d)),
    "persona_summary": lambda s, d: reports.persona_summary(scored_drivers(s, d)),
    "exec_kpis": lambda s, d: reports.executive_kpis(scored_drivers(s, d)),
    "ops_kpis": lambda s, d: reports.ops_kpis(_marked(s, d)),
    "persona_breakdown": lambda s, d: _rounded(
        reports.persona_breakdown(scored_drivers(s, d)), 6, "mean_churn"
    ),
    "ab_test_sizes": lambda s, d: reports.ab_test_sizes(_armed(s, d)),
    "top_risk": lambda s, d: reports.top_risk(scored_drivers(s, d)),
    "scored_by_risk": lambda s, d: reports.by_risk(
        scored_drivers(s, d).select("driver_id", "persona", "churn_probability", "is_high_risk")
    ),
}


# --- SQL ------------------------------------------------------------------------------------


def uniform_sql(stream: str, key: str, part: int = 0, seed: int = SEED) -> str:
    word = f"substr(md5('{seed}:{stream}:' || {key}), {part * 8 + 1}, 8)"
    return f"((('0x' || {word})::BIGINT)::DOUBLE + 0.5) / 4294967296::DOUBLE"


def _normal_sql(stream: str) -> str:
    return (
        f"sqrt(ln({uniform_sql(stream, 'c_custkey', 0)}) * -2.0)"
        f" * cos(({uniform_sql(stream, 'c_custkey', 1)}) * (2.0 * pi()))"
    )


def _exp_sql(stream: str, scale: str) -> str:
    return f"ln(1.0 - ({uniform_sql(stream, 'c_custkey')})) * (-{scale})"


def _clip_sql(text: str, low: str, high: str) -> str:
    return f"greatest({low}::DOUBLE, least({text}, {high}::DOUBLE))"


def _benchmark_sql(source: str) -> str:
    return f"""
        SELECT {rounded("quantile_cont(avg_earnings_per_hour_online, 0.5)", 2)} AS pro_epho_median,
               {rounded("quantile_cont(trip_utilization_rate, 0.5) * 100", 1)} AS pro_util_median,
               {rounded("quantile_cont(cancellation_rate, 0.5) * 100", 1)} AS pro_cancel_median
        FROM {source}"""


_E = "coalesce(avg_earnings_per_hour_online, 0)"
_C = "coalesce(cancellation_rate, 0)"


def _fixed_sql(text: str, places: int) -> str:
    return f"printf('%.{places}f', {rounded(text, places)})"


CHAIN = {
    **SCORED_SQL,
    "armed": f"""
        SELECT *, CASE WHEN persona = 'Casual / At-Risk' AND is_high_risk THEN
                    CASE WHEN {uniform_sql("arm", "driver_id")} < 0.5 THEN 'nudge' ELSE 'control' END
                  END AS ab_group
        FROM scored""",
    "tiers": """
        SELECT *, tier_span - done AS trips_remaining,
               CASE WHEN tier_span IS NOT NULL THEN
                 CAST(least(trunc(done::DOUBLE / tier_span * 100), 100) AS INT) END AS tier_percent
        FROM (SELECT *,
                     ['Blue', 'Gold', 'Platinum', 'Diamond'][pro_tier_rank] AS tier,
                     ['Gold', 'Platinum', 'Diamond'][pro_tier_rank] AS next_tier,
                     [100, 150, 250][pro_tier_rank]::BIGINT AS tier_span,
                     greatest(0, coalesce(session_count, 10) - [0, 100, 250, 500][pro_tier_rank])
                       ::BIGINT AS done
              FROM armed)""",
    "bench": _benchmark_sql("scored WHERE persona = 'Pro-Optimizer'"),
    "messages": f"""
        SELECT driver_id, variant,
               CASE variant
                 WHEN 'LOW_EARNINGS' THEN 'Hourly earnings: you $' || earn_txt
                                          || ', top drivers $' || bench_txt
                 WHEN 'HIGH_CANCEL' THEN 'Fewer cancellations keep your tier benefits safe'
                 ELSE 'Your way to ' || coalesce(next_tier, 'Diamond') END AS subject,
               concat_ws(chr(10), 'Week of {WEEK}.',
                 CASE variant
                 WHEN 'LOW_EARNINGS' THEN concat_ws(chr(10),
                   'An online hour brings you $' || earn_txt
                     || '; the best-earning drivers make $' || bench_txt
                     || ', a difference of $' || gap_txt || '.',
                   'You spend ' || use_txt || '% of your online time on trips, they spend '
                     || util_txt || '%. You complete ' || quest_txt
                     || '% of the Quests you are offered.',
                   'Start near demand before the rush, follow surge areas and finish open Quests.',
                   progress)
                 WHEN 'HIGH_CANCEL' THEN concat_ws(chr(10),
                   'You cancel ' || cancel_txt
                     || '% of the trips you accept; the best-earning drivers cancel '
                     || cancel_bench_txt || '%.',
                   'Look at the destination first and turn down a trip before accepting it, not after.',
                   progress)
                 ELSE concat_ws(chr(10),
                   'Your tier today is ' || tier || '. ' || progress,
                   'Drivers ahead of you make $' || bench_txt || ' an hour, you make $'
                     || earn_txt || '.',
                   'Peak hours, open Quests and fewer cancellations (now ' || cancel_txt
                     || '%) get you there.') END) AS body,
               '{WEEK}' AS generated_at
        FROM (SELECT *,
                CASE WHEN coalesce(avg_earnings_per_hour_online, 99) < 15 THEN 'LOW_EARNINGS'
                     WHEN {_C} > 0.15 THEN 'HIGH_CANCEL' ELSE 'GOAL_GRADIENT' END AS variant,
                {_fixed_sql(_E, 2)} AS earn_txt, {_fixed_sql("pro_epho_median", 2)} AS bench_txt,
                {_fixed_sql(f"pro_epho_median - {rounded(_E, 2)}", 2)} AS gap_txt,
                {_fixed_sql("coalesce(trip_utilization_rate, 0) * 100", 1)} AS use_txt,
                {_fixed_sql("coalesce(quest_completion_rate, 0) * 100", 1)} AS quest_txt,
                {_fixed_sql(f"{_C} * 100", 1)} AS cancel_txt,
                {_fixed_sql("pro_util_median", 1)} AS util_txt,
                {_fixed_sql("pro_cancel_median", 1)} AS cancel_bench_txt,
                coalesce('From ' || tier || ' to ' || next_tier || ': ' || tier_percent
                         || '% done, ' || trips_remaining || ' trips left.',
                         'You hold the highest tier.') AS progress
              FROM tiers, bench WHERE ab_group = 'nudge')""",
    "marked": "SELECT *, ab_group IS NOT DISTINCT FROM 'nudge' AS nudge_sent FROM armed",
}


def chain(body: str, *extra: str) -> str:
    """``body`` over the scoring and campaign chain."""
    return sql(body, "features", *extra, extra=CHAIN)


_CALIBRATION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, "
    + ", ".join(
        f"{rounded(f'{fn}({c})', 3)} AS {name}"
        for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )
    + " FROM features"
    for c in CALIBRATED_FEATURES
)
_DRAWN = (
    "trip_utilization_rate",
    "surge_reliance_score",
    "quest_completion_rate",
    "cancellation_rate",
    "acceptance_rate",
    "peak_hour_driver_score",
    "incentive_reliance_pct",
)
_COHORT_STATS = ", ".join(
    [f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _DRAWN]
    + ["ln(avg(avg_earnings_per_hour_online)) AS mu"]
)
_HEX = f"md5('{SEED}:driver:' || c_custkey)"
_PREMIUM = f"""CASE WHEN {uniform_sql("is_specialist", "c_custkey")} < 0.15
    THEN {_clip_sql(f"({_normal_sql('specialist_ratio')}) * 0.12 + 0.75", "0.4", "1.0")}
    ELSE {_clip_sql(_exp_sql("ordinary_ratio", "0.04"), "0", "0.35")} END"""
_TIER = uniform_sql("tier", "c_custkey")
_NORMALS = ", ".join(
    rounded(_clip_sql(f"m_{c} + s_{c} * ({_normal_sql(c)})", "0", "1"), 4) + f" AS {c}"
    for c in _DRAWN
)

_METRICS = {
    "acceptance_rate": "Acceptance Rate",
    "trip_utilization_rate": "Trip Utilization",
    "surge_reliance_score": "Surge Reliance",
    "quest_completion_rate": "Quest Completion",
    "cancellation_rate": "Cancellation Rate",
    "avg_earnings_per_hour_online": "Avg Earnings/Hr",
}


def _fingerprint_sql(by: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {by}, '{label}' AS metric,
                   {rounded(f"(avg({c}) - (SELECT min({c}) FROM scored)) / "
                            f"((SELECT max({c}) FROM scored) - (SELECT min({c}) FROM scored))", 6)}
                     AS score
            FROM scored GROUP BY {by}"""
        for c, label in metrics.items()
    )


_GAP_METRICS = {
    "trip_utilization_rate": "Asset Utilization",
    "surge_reliance_score": "Market Intelligence",
    "quest_completion_rate": "Goal Achievement",
    "avg_earnings_per_hour_online / (SELECT max(avg_earnings_per_hour_online) FROM scored "
    "WHERE persona <> 'Premium Specialist')": "Earnings Efficiency (normalized)",
}
_GAP = " UNION ALL ".join(
    f"""SELECT CASE persona WHEN 'Casual / At-Risk' THEN 'Casual (The Rookie)'
                            WHEN 'Pro-Optimizer' THEN 'Pro-Optimizer (The Strategist)'
                            ELSE 'Quest Grinder (The Hustler)' END AS persona,
               '{label}' AS metric, {rounded(f"avg({c})", 6)} AS score
        FROM scored WHERE persona <> 'Premium Specialist' GROUP BY persona"""
    for c, label in _GAP_METRICS.items()
)

ORACLE = {
    "risk_band": chain(
        """SELECT driver_id, churn_probability,
                  CASE WHEN churn_probability < 0.35 THEN 'low' WHEN churn_probability < 0.55
                       THEN 'medium' ELSE 'high' END AS band FROM scored"""
    ),
    "ab_assignment": chain("SELECT driver_id, ab_group FROM armed"),
    "ab_group_sizes": chain(
        """SELECT (count(*) FILTER (ab_group = 'nudge'))::BIGINT AS nudge_group_size,
                  (count(*) FILTER (ab_group = 'control'))::BIGINT AS control_group_size FROM armed"""
    ),
    "campaign_targets": chain(
        """SELECT driver_id, persona FROM armed
           WHERE persona = 'Casual / At-Risk' AND is_high_risk AND ab_group = 'nudge'"""
    ),
    "lift_evaluation": chain(
        f"""SELECT {rounded("n", 6)} AS nudge_retention, {rounded("c", 6)} AS control_retention,
                   {rounded("n - c", 6)} AS lift, n - c >= 0.05 AS scale_up
            FROM (SELECT avg(1 - "Churned") FILTER (ab_group = 'nudge') AS n,
                         avg(1 - "Churned") FILTER (ab_group = 'control') AS c FROM armed)"""
    ),
    "benchmarks_median": chain("SELECT * FROM bench"),
    "benchmarks_quartile": chain(
        _benchmark_sql(
            """scored WHERE avg_earnings_per_hour_online >=
               (SELECT quantile_cont(avg_earnings_per_hour_online, 0.75) FROM scored)"""
        )
    ),
    "variant_select": chain(
        f"""SELECT driver_id,
                   CASE WHEN coalesce(avg_earnings_per_hour_online, 99) < 15 THEN 'LOW_EARNINGS'
                        WHEN {_C} > 0.15 THEN 'HIGH_CANCEL' ELSE 'GOAL_GRADIENT' END AS variant
            FROM scored"""
    ),
    "tier_progress": chain(
        "SELECT driver_id, tier, next_tier, trips_remaining, tier_percent FROM tiers"
    ),
    "nudge_messages": chain("SELECT * FROM messages"),
    "outbox_rows": chain(
        """SELECT driver_id, driver_id::VARCHAR || '@drivers.example' AS recipient, subject,
                  'nudge:' || variant AS "type", 'skipped' AS status, '' AS error FROM messages"""
    ),
    "nudge_sent_flag": chain("SELECT driver_id, nudge_sent FROM marked"),
    "run_summary": chain(
        """SELECT count(*)::BIGINT AS cohort_size,
                  (count(*) FILTER (is_high_risk))::BIGINT AS high_risk_count,
                  (count(*) FILTER (ab_group = 'nudge'))::BIGINT AS nudge_group_size,
                  (count(*) FILTER (ab_group = 'control'))::BIGINT AS control_group_size,
                  (count(*) FILTER (nudge_sent))::BIGINT AS nudges_generated,
                  (count(*) FILTER (persona = 'Casual / At-Risk'))::BIGINT AS casual_count,
                  (count(*) FILTER (persona = 'Quest Grinder'))::BIGINT AS quest_count,
                  (count(*) FILTER (persona = 'Premium Specialist'))::BIGINT AS premium_count,
                  (count(*) FILTER (persona = 'Pro-Optimizer'))::BIGINT AS pro_count
           FROM marked"""
    ),
    "driver_record": chain(
        """SELECT driver_id, persona, churn_probability, is_high_risk FROM scored
           WHERE driver_id = (SELECT max(driver_id) FROM scored)"""
    ),
    "dispatch_log_newest": chain(
        """SELECT signup_date::TIMESTAMP::VARCHAR AS "timestamp",
                  driver_id || '@drivers.example' AS recipient, subject,
                  'nudge:' || variant AS "type", 'skipped' AS status, '' AS error
           FROM messages JOIN scored USING (driver_id) ORDER BY 1 DESC, 2"""
    ),
    "cohort_calibration": sql(_CALIBRATION, "features"),
    "cohort_synthetic": sql(
        f"""SELECT {", ".join(COHORT_COLUMNS)} FROM (
            SELECT concat_ws('-', substr(hex, 1, 8), substr(hex, 9, 4), substr(hex, 13, 4),
                             substr(hex, 17, 4), substr(hex, 21, 12)) AS driver_id,
                   '{WEEK}' AS signup_date, '{WEEK}' AS week,
                   {rounded(_clip_sql(f"({_normal_sql('rating')}) * 0.15 + 4.75", "4", "5"), 2)}
                     AS avg_rating,
                   CASE WHEN premium > 0.3 THEN 1 ELSE 0 END AS is_premium_capable,
                   {rounded("premium", 4)} AS premium_trip_ratio,
                   CASE WHEN {_TIER} < 0.45 THEN 1 WHEN {_TIER} < 0.75 THEN 2
                        WHEN {_TIER} < 0.9 THEN 3 ELSE 4 END AS pro_tier_rank,
                   {rounded(_clip_sql(f"exp(mu + ({_normal_sql('earnings')}) * 0.5)", "3", "80"), 4)}
                     AS avg_earnings_per_hour_online,
                   {_NORMALS},
                   {rounded(_clip_sql(_exp_sql("regularity", "40.0"), "0", "300"), 2)}
                     AS session_regularity,
                   CAST(floor(({uniform_sql("sessions", "c_custkey")}) * 199) + 1 AS INT)
                     AS session_count
            FROM (SELECT c_custkey, {_HEX} AS hex, {_PREMIUM} AS premium FROM customer),
                 (SELECT {_COHORT_STATS} FROM features))""",
        "features",
    ),
    "label_titles": sql(
        """SELECT code, n::BIGINT AS n,
                  list_aggregate(list_transform(string_split(replace(code, '_', ' '), ' '),
                    lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS label
           FROM (SELECT trip_type AS code, count(*) AS n FROM trips GROUP BY 1
                 UNION ALL SELECT event_type, count(*) FROM interactions GROUP BY 1)""",
        "trips",
        "interactions",
    ),
    "fingerprint_long": chain(_fingerprint_sql("persona", _METRICS)),
    "fingerprint_clusters": chain(_fingerprint_sql("cluster_label", CLUSTER_METRICS)),
    "maturity_gap": chain(_GAP),
    "earnings_composition": chain(
        f"""SELECT persona, component, {rounded("avg(pct)", 6)} AS pct, NULL::VARCHAR AS note
            FROM (SELECT persona, unnest(['Organic (Fare + Tip)', 'Inorganic (Quest Bonuses)'])
                           AS component,
                         unnest([organic / nullif(organic + extra, 0) * 100,
                                 extra / nullif(organic + extra, 0) * 100]) AS pct
                  FROM (SELECT persona, coalesce(earned, 0) AS organic, coalesce(bonus, 0) AS extra
                        FROM scored LEFT JOIN rides USING (driver_id)
                        LEFT JOIN bonuses USING (driver_id)
                        WHERE persona IN ('Quest Grinder', 'Pro-Optimizer')))
            GROUP BY persona, component""",
        "rides",
        "bonuses",
    ),
    "box_stats_by_persona": chain(box_sql(BY_LABEL, "persona", 6, "scored")),
    "churn_by_persona": chain(
        'SELECT persona, avg("Churned") AS churn_rate FROM scored GROUP BY persona'
    ),
    "persona_summary": chain(
        f"""SELECT persona, count(*)::BIGINT AS drivers, avg("Churned") AS churn_rate,
                   {_fixed_sql('avg("Churned") * 100', 1)} || '%' AS churn_label
            FROM scored GROUP BY persona"""
    ),
    "exec_kpis": chain(
        """SELECT count(*)::BIGINT AS total_drivers, avg("Churned") AS churn_rate,
                  avg("Churned") FILTER (persona = 'Casual / At-Risk') AS at_risk_churn_rate
           FROM scored"""
    ),
    "ops_kpis": chain(
        """SELECT count(*)::BIGINT AS drivers_scored,
                  (count(*) FILTER (is_high_risk))::BIGINT AS high_risk,
                  (count(*) FILTER (persona = 'Casual / At-Risk'))::BIGINT AS casual,
                  (count(*) FILTER (nudge_sent))::BIGINT AS nudges_sent FROM marked"""
    ),
    "persona_breakdown": chain(
        f"""SELECT persona, count(driver_id)::BIGINT AS drivers,
                   {rounded("avg(churn_probability)", 6)} AS mean_churn,
                   (count(*) FILTER (is_high_risk))::BIGINT AS high_risk
            FROM scored GROUP BY persona"""
    ),
    "ab_test_sizes": chain(
        """SELECT (count(*) FILTER (ab_group = 'nudge'))::BIGINT AS nudge,
                  (count(*) FILTER (ab_group = 'control'))::BIGINT AS control
           FROM armed WHERE persona = 'Casual / At-Risk'"""
    ),
    "top_risk": chain(
        f"""SELECT driver_id, substr(driver_id::VARCHAR, 1, 8) || '…' AS short_id, persona,
                   churn_probability, {_fixed_sql("churn_probability * 100", 1)} || '%' AS risk_label
            FROM scored WHERE is_high_risk ORDER BY churn_probability DESC, driver_id LIMIT 10"""
    ),
    "scored_by_risk": chain(
        """SELECT driver_id, persona, churn_probability, is_high_risk FROM scored
           ORDER BY churn_probability DESC, driver_id"""
    ),
}
