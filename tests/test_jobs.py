"""Segmentation, churn, campaign, reports and the weekly job on small tables."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetcohort.plans import campaign, churn, cohort, reports, scoring, segments
from fleetcohort.plans.weekly import run_week
from fleetcohort.settings import (
    CASUAL,
    CHURN_NUMERIC_FEATURES,
    CLUSTERING_FEATURES,
    COHORT_COLUMNS,
    FALLBACK_BENCHMARKS,
    PREMIUM,
    PRO,
    QUEST,
    SEARCH_SPACE,
)
from fleetcohort.sources import artefacts, sinks
from fleetcohort.sources.raw import MissingSource
from fleetcohort.sources.staging import stage

WEEK = "2024-06-03"

# Earnings, utilisation, surge, premium ratio, quests, cancellations of four clear groups.
GROUPS = {
    CASUAL: (9.0, 0.20, 0.05, 0.02, 0.10, 0.30),
    QUEST: (18.0, 0.55, 0.10, 0.03, 0.85, 0.05),
    PREMIUM: (30.0, 0.45, 0.12, 0.80, 0.30, 0.05),
    PRO: (35.0, 0.75, 0.40, 0.05, 0.40, 0.02),
}


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        group = list(GROUPS)[i % 4]
        base = GROUPS[group]
        values = [max(b * (1 + rng.gauss(0, 0.05)), 0.0) for b in base]
        churned = int(rng.random() < (0.9 if group == CASUAL else 0.05))
        missing = None if i % 50 == 7 else rng.random()
        rows.append(
            (f"driver-{i:04d}", group, churned, *values, missing, 1 + i % 4, 0.3, 20.0, 0.1, 4.7, 5 + i % 90)
        )
    names = (
        "driver_id string, truth string, Churned int, "
        + ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)
        + ", acceptance_rate double, pro_tier_rank int, peak_hour_driver_score double, "
        "session_regularity double, incentive_reliance_pct double, avg_rating double, "
        "session_count int"
    )
    return stage(spark.createDataFrame(rows, names), "history")


@pytest.fixture(scope="module")
def segment_model(history):
    return segments.fit_segments(history, starts=5)


@pytest.fixture(scope="module")
def churn_model(history, segment_model):
    clustered = stage(segment_model.transform(history), "clustered")
    return churn.fit_churn(clustered, {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3})


@pytest.fixture(scope="module")
def scored(history, segment_model, churn_model):
    return stage(scoring.score_drivers(history, segment_model, churn_model), "scored")


def test_personas_are_recovered(scored):
    assert scored.filter("persona <> truth").count() == 0


def test_missing_values_count_as_zero(spark, segment_model):
    df = spark.createDataFrame(
        [tuple([None] * 6), tuple([0.0] * 6)], ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)
    )
    assert len({r["cluster_label"] for r in segment_model.transform(df).collect()}) == 1


def test_cost_falls_with_k(history):
    costs = [r["training_cost"] for r in segments.elbow(history, range(2, 6)).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)


def _personas(spark, rows):
    schema = "cluster_label int, " + ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)
    table = segments.persona_rules(spark.createDataFrame(rows, schema))
    return {r["cluster_label"]: r["persona"] for r in table.collect()}


def test_persona_thresholds_are_strict(spark):
    got = _personas(
        spark,
        [
            (0, 1.0, 0.40, 0.9, 0.35, 0.50, 0.0),  # every value exactly on its threshold
            (1, 1.0, 0.41, 0.9, 0.36, 0.51, 0.0),  # premium wins over the others
            (2, 1.0, 0.41, 0.9, 0.10, 0.51, 0.0),
            (3, 1.0, 0.90, 0.0, 0.10, 0.51, 0.0),
            (4, 1.0, 0.90, 0.0, 0.10, 0.60, 0.0),
        ],
    )
    assert got == {0: CASUAL, 1: PREMIUM, 2: PRO, 3: QUEST, 4: QUEST}


def test_models_survive_saving(spark, history, scored, segment_model, churn_model, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(MissingSource):
        artefacts.load_models(spark, root)
    artefacts.save_models(root, segment_model, churn_model)
    again = scoring.score_drivers(history, *artefacts.load_models(spark, root))
    keys = ["driver_id", "persona", "churn_probability", "is_high_risk"]
    assert again.select(*keys).exceptAll(scored.select(*keys)).count() == 0


def test_churn_model_learns(scored):
    from fleetcohort.plans.evaluation import roc_auc

    assert roc_auc(scored, "Churned", "churn_probability").first()["auc"] > 0.85
    assert scored.filter("is_high_risk <> (churn_probability >= 0.5)").count() == 0


def test_importances_sum_to_one(spark, churn_model):
    rows = churn.feature_importance(spark, churn_model).collect()
    assert len(rows) == 9
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_scoring_names_missing_columns(history, segment_model, churn_model):
    with pytest.raises(KeyError, match="acceptance_rate"):
        scoring.score_drivers(history.drop("acceptance_rate"), segment_model, churn_model)


def test_search_draws_are_distinct_and_stable():
    first = churn.draw_settings(SEARCH_SPACE, 50)
    assert first == churn.draw_settings(SEARCH_SPACE, 50)
    assert len({tuple(s.items()) for s in first}) == 50
    assert all(s[n] in SEARCH_SPACE[n] for s in first for n in SEARCH_SPACE)
    assert len(churn.draw_settings({"a": [1, 2]}, 50)) == 2


def test_training_run(spark, history, segment_model, tmp_path):
    clustered = stage(segment_model.transform(history), "train")
    space = {"n_estimators": [2, 3], "max_depth": [2, 3], "learning_rate": [0.3]}
    run = churn.train_churn(clustered, draws=4, folds=2, space=space)
    assert run.metrics.keys() == {
        f"{side}_{m}"
        for side in ("train", "test")
        for m in ("accuracy", "roc_auc", "precision", "recall", "f1")
    } | {"cv_best_roc_auc"}
    assert run.metrics["test_roc_auc"] > 0.5
    sinks.append_run_log(spark, str(tmp_path / "runs"), "r", run.params, run.metrics)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == len(run.params) + 11


def test_split_does_not_depend_on_layout(history):
    a = {r["driver_id"]: r["is_test"] for r in churn.with_split(history.repartition(1)).collect()}
    b = {r["driver_id"]: r["is_test"] for r in churn.with_split(history.repartition(9)).collect()}
    assert a == b
    assert 0.12 < sum(a.values()) / len(a) < 0.28


# --- campaign ------------------------------------------------------------------------


def _scored_rows(spark, rows):
    schema = (
        "driver_id string, persona string, is_high_risk boolean, "
        "avg_earnings_per_hour_online double, cancellation_rate double, "
        "trip_utilization_rate double, quest_completion_rate double, "
        "pro_tier_rank int, session_count int"
    )
    full = [(d, p, r, e, c, 0.5, 0.5, t, n) for d, p, r, e, c, t, n in rows]
    return spark.createDataFrame(full, schema)


def test_variants(spark):
    df = _scored_rows(
        spark,
        [
            ("low", CASUAL, True, 14.99, 0.9, 1, 1),
            ("edge", CASUAL, True, 15.0, 0.15, 1, 1),
            ("cancel", CASUAL, True, 15.0, 0.1501, 1, 1),
            ("unknown", CASUAL, True, None, None, 1, 1),
        ],
    )
    got = {r["driver_id"]: r["v"] for r in df.select("driver_id", campaign.variant().alias("v")).collect()}
    assert got == {
        "low": "LOW_EARNINGS",
        "edge": "GOAL_GRADIENT",
        "cancel": "HIGH_CANCEL",
        "unknown": "GOAL_GRADIENT",
    }


def test_tier_progress(spark):
    df = _scored_rows(
        spark,
        [
            ("top", CASUAL, True, 20.0, 0.0, 4, 900),
            ("past", CASUAL, True, 20.0, 0.0, 1, 300),
            ("mid", CASUAL, True, 20.0, 0.0, 2, 199),
            ("under", CASUAL, True, 20.0, 0.0, 3, 10),
        ],
    )
    rows = {r["driver_id"]: r for r in campaign.with_tier_progress(df).collect()}
    pick = lambda r: (r["tier"], r["next_tier"], r["trips_remaining"], r["tier_percent"])
    assert pick(rows["top"]) == ("Diamond", None, None, None)
    assert pick(rows["past"]) == ("Blue", "Gold", -200, 100)
    assert pick(rows["mid"]) == ("Gold", "Platinum", 51, 66)
    assert pick(rows["under"]) == ("Platinum", "Diamond", 250, 0)


def test_arms_only_inside_the_campaign(scored):
    armed = campaign.assign_arms(scored)
    outside = armed.filter(F.col("ab_group").isNotNull() & ~campaign.in_campaign())
    assert outside.count() == 0
    assert armed.filter(campaign.in_campaign() & F.col("ab_group").isNull()).count() == 0
    again = campaign.assign_arms(scored.repartition(5))
    assert again.select("driver_id", "ab_group").exceptAll(armed.select("driver_id", "ab_group")).count() == 0
    sizes = campaign.arm_sizes(armed).first()
    assert sizes["nudge_group_size"] > 10 and sizes["control_group_size"] > 10


def test_without_arms_everyone_in_the_campaign_is_a_target(scored):
    assert campaign.targets(scored).count() == scored.filter(campaign.in_campaign()).count()
    assert reports.ab_test_sizes(scored) is None


def test_benchmarks(spark, history, scored):
    from statistics import median

    pro = [r for r in scored.collect() if r["persona"] == PRO]
    got = campaign.benchmarks(scored).first()
    assert got["pro_epho_median"] == pytest.approx(
        median(r["avg_earnings_per_hour_online"] for r in pro), abs=0.006
    )
    assert got["pro_util_median"] == pytest.approx(
        100 * median(r["trip_utilization_rate"] for r in pro), abs=0.06
    )
    # No such persona: the top quarter by earnings.
    other = campaign.benchmarks(scored.withColumn("persona", F.lit(CASUAL))).first()
    assert other == campaign.benchmarks(history).first()
    # No history at all: the constants.
    assert campaign.benchmarks(history.limit(0)).first().asDict() == FALLBACK_BENCHMARKS


def test_messages_mention_the_numbers(spark):
    df = _scored_rows(
        spark,
        [
            ("a", CASUAL, True, 12.5, 0.0, 1, 40),
            ("b", CASUAL, True, 20.0, 0.25, 2, 40),
            ("c", CASUAL, True, 20.0, 0.0, 4, 40),
            ("d", CASUAL, False, 1.0, 0.0, 1, 40),
            ("e", PRO, True, 1.0, 0.0, 1, 40),
        ],
    )
    bench = spark.createDataFrame([tuple(FALLBACK_BENCHMARKS.values())], list(FALLBACK_BENCHMARKS))
    rows = {r["driver_id"]: r for r in campaign.nudges(df, bench, WEEK).collect()}
    assert rows.keys() == {"a", "b", "c"}
    assert "$12.50" in rows["a"]["subject"] and "$28.00" in rows["a"]["subject"]
    assert "$15.50" in rows["a"]["body"] and "40% done, 60 trips left" in rows["a"]["body"]
    assert "25.0%" in rows["b"]["body"] and "3.0%" in rows["b"]["body"]
    assert rows["c"]["subject"].endswith("Diamond") and "highest tier" in rows["c"]["body"]
    assert rows["a"]["generated_at"] == date(2024, 6, 3)
    sent = campaign.outbox(campaign.nudges(df, bench, WEEK)).collect()
    assert {r["type"] for r in sent} == {"nudge:LOW_EARNINGS", "nudge:HIGH_CANCEL", "nudge:GOAL_GRADIENT"}
    assert {r["status"] for r in sent} == {"skipped"}
    assert {r["driver_id"] for r in sent} == {"a", "b", "c"}


def test_outbox_keeps_whole_ids(spark):
    rows = [(1234567801, "LOW_EARNINGS", "s"), (1234567802, "LOW_EARNINGS", "s")]
    messages = spark.createDataFrame(rows, "driver_id long, variant string, subject string")
    assert {r["recipient"] for r in campaign.outbox(messages).collect()} == {
        "1234567801@drivers.example",
        "1234567802@drivers.example",
    }


def test_nan_signals_select_no_variant(spark):
    nan = float("nan")
    rows = [("a", nan, nan), ("b", 20.0, nan), ("c", nan, 0.5), ("d", 5.0, 0.9)]
    df = spark.createDataFrame(
        rows, "driver_id string, avg_earnings_per_hour_online double, cancellation_rate double"
    )
    got = {r["driver_id"]: r["v"] for r in df.select("driver_id", campaign.variant().alias("v")).collect()}
    assert got == {
        "a": "GOAL_GRADIENT", "b": "GOAL_GRADIENT", "c": "HIGH_CANCEL", "d": "LOW_EARNINGS",
    }


def test_nan_features_are_scored_as_missing(spark, history, segment_model, churn_model):
    column = "cancellation_rate"
    three = history.limit(3)
    keys = ["driver_id", "persona", "churn_probability"]
    nan = scoring.score_drivers(three.withColumn(column, F.lit(float("nan"))), segment_model, churn_model)
    null = scoring.score_drivers(
        three.withColumn(column, F.lit(None).cast("double")), segment_model, churn_model
    )
    assert sorted(nan.select(*keys).collect()) == sorted(null.select(*keys).collect())


def test_folds_are_balanced_within_each_class(spark):
    df = spark.range(1003).select(
        F.col("id").alias("driver_id"), (F.col("id") % 3 == 0).cast("int").alias("Churned")
    )
    counts = churn.with_folds(df, 5).groupBy("Churned", "fold").count().collect()
    for label in (0, 1):
        own = [r["count"] for r in counts if r["Churned"] == label]
        assert len(own) == 5 and max(own) - min(own) <= 1


@pytest.mark.parametrize("gamma", SEARCH_SPACE["gamma"])
def test_every_gamma_of_the_search_still_splits(scored, gamma):
    earnings = "avg_earnings_per_hour_online"
    (median,) = scored.approxQuantile(earnings, [0.5], 0.01)
    planted = scored.withColumn("Churned", F.coalesce(F.col(earnings) > median, F.lit(False)).cast("int"))
    model = churn.fit_churn(planted, {"n_estimators": 1, "max_depth": 2, "gamma": gamma})
    assert model.trees[0].feature[1] == CHURN_NUMERIC_FEATURES.index(earnings)


def test_lift(spark):
    rows = [("nudge", 1), ("nudge", 1), ("control", 1), ("control", 0), (None, 0)]
    row = campaign.lift(spark.createDataFrame(rows, "ab_group string, kept int"), "kept").first()
    assert (row["nudge_retention"], row["control_retention"], row["lift"]) == (1.0, 0.5, 0.5)
    assert row["scale_up"] is True


# --- reports -----------------------------------------------------------------------------


def test_driver_without_earnings_has_no_share(spark):
    from tests.test_features import incentives, trip, trips

    segmented = spark.createDataFrame(
        [("a", PRO), ("b", PRO), ("c", CASUAL)], "driver_id string, persona string"
    )

    class Logs:
        pass

    logs = Logs()
    logs.trips = trips(spark, [trip("a", fare=30.0), trip("c", fare=1.0)])
    logs.incentives = incentives(spark, [("a", "Quest", "completed", 10.0), ("b", "Quest", "failed", 9.0)])
    rows = {r["component"]: r["pct"] for r in reports.earnings_composition(segmented, logs).collect()}
    assert rows == {"Organic (Fare + Tip)": 75.0, "Inorganic (Quest Bonuses)": 25.0}


def test_top_risk_breaks_ties_by_id(spark):
    rows = [(f"driver-{i:02d}", CASUAL, 0.9 if i % 2 else 0.4, bool(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "driver_id string, persona string, churn_probability double, is_high_risk boolean")
    got = reports.top_risk(df.repartition(6), 5).collect()
    assert [r["driver_id"] for r in got] == ["driver-01", "driver-03", "driver-05", "driver-07", "driver-09"]
    assert got[0]["short_id"] == "driver-0…" and got[0]["risk_label"] == "90.0%"


# --- cohort and weekly job ------------------------------------------------------------------


def test_cohort_shape_and_bounds(spark, history):
    df = cohort.weekly_cohort(spark, history, WEEK, n=3000, seed=7)
    assert df.columns == COHORT_COLUMNS
    rows = df.toPandas()
    assert rows["driver_id"].nunique() == 3000
    assert rows["avg_earnings_per_hour_online"].between(3, 80).all()
    assert rows["session_count"].between(1, 199).all()
    assert rows["avg_rating"].between(4, 5).all()
    for c in CLUSTERING_FEATURES[1:] + ["acceptance_rate", "peak_hour_driver_score"]:
        assert rows[c].between(0, 1).all(), c
    assert ((rows["premium_trip_ratio"] > 0.3001) <= (rows["is_premium_capable"] == 1)).all()
    share = rows["pro_tier_rank"].value_counts(normalize=True)
    assert [round(share[r], 1) for r in (1, 2, 3, 4)] == pytest.approx([0.45, 0.3, 0.15, 0.1], abs=0.06)
    assert 0.1 < (rows["premium_trip_ratio"] >= 0.4).mean() < 0.2


def test_cohort_is_reproducible_and_changes_by_week(spark, history):
    a = cohort.weekly_cohort(spark, history, WEEK, n=50)
    b = cohort.weekly_cohort(spark, history, WEEK, n=50)
    c = cohort.weekly_cohort(spark, history, "2024-06-10", n=50)
    assert a.exceptAll(b).count() == 0
    assert a.join(c, "driver_id", "left_semi").count() == 0


def test_weekly_job(spark, history, scored, segment_model, churn_model, tmp_path):
    out = str(tmp_path)

    def run(week):
        return run_week(spark, scored, segment_model, churn_model, out, week, n=200)

    tables = run(WEEK)
    summary = tables["summary"].first()
    assert summary["cohort_size"] == 200
    assert summary["nudges_generated"] == summary["nudge_group_size"] > 0
    assert tables["kpis"].first()["nudges_sent"] == summary["nudges_generated"]
    assert sum(r["drivers"] for r in tables["persona_breakdown"].collect()) == 200
    assert tables["top_risk"].count() == min(10, summary["high_risk_count"])
    log = sinks.read_dispatch_log(spark, f"{out}/dispatch_log")
    assert log.count() == summary["nudges_generated"]

    run("2024-06-10")
    again = run(WEEK)["summary"].first()
    assert again == summary
    # One row a message, though the week was run twice.
    sent = spark.read.parquet(f"{out}/outbox").count()
    assert sinks.read_dispatch_log(spark, f"{out}/dispatch_log").count() == sent
    stored = spark.read.parquet(f"{out}/scored_cohort")
    assert stored.count() == 400
    assert stored.filter("nudge_sent AND ab_group <> 'nudge'").count() == 0
    assert set(CHURN_NUMERIC_FEATURES) <= set(stored.columns)


def test_command_line_end_to_end(spark, tiny, tmp_path, capsys, monkeypatch):
    """Raw CSV files to a campaign week, each step reading what the one before wrote."""
    from fleetcohort import __main__ as cli
    from fleetcohort.plans import training
    from tests.test_sources import _write_raw

    raw, table, out = (str(tmp_path / n) for n in ("raw", "features", "out"))
    _write_raw(spark, tiny, raw, "csv")
    cli.run(spark, ["quality", raw])
    assert "domain of trip_type" in capsys.readouterr().out
    cli.run(spark, ["features", raw, table])
    quick = {"n_estimators": [2], "max_depth": [2, 3]}
    monkeypatch.setattr(
        cli,
        "run_training",
        lambda s, f, o, r, draws, folds: training.run_training(
            s, f, o, r, starts=2, draws=draws, folds=folds, space=quick
        ),
    )
    cli.run(spark, ["train", table, out, "run-1", "--draws", "1", "--folds", "2"])
    assert "test_roc_auc" in capsys.readouterr().out
    cli.run(spark, ["week", out, WEEK, "--drivers", "60", "--seed", "3"])
    shown = capsys.readouterr().out
    assert "persona_breakdown" in shown and "top_risk" in shown
    cli.run(spark, ["log", out])
    assert spark.read.parquet(f"{out}/scored_cohort").count() == 60
    assert spark.read.parquet(f"{out}/runs").filter("key = 'test_roc_auc'").count() == 1
