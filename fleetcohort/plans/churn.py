"""Churn classifier: split, weights, boosted trees, sampled search, scoring."""

from __future__ import annotations

import random
from dataclasses import dataclass
from math import prod

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import draw, in_share
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.plans.boosting import DEFAULTS, Ensemble, Run, boost
from fleetcohort.plans.evaluation import class_balance, classification_report, roc_auc
from fleetcohort.settings import (
    CHURN_FEATURES,
    CHURN_NUMERIC_FEATURES,
    HIGH_RISK_FROM,
    SEARCH_DRAWS,
    SEARCH_FOLDS,
    SEARCH_SPACE,
    SEED,
    TEST_SHARE,
)
from fleetcohort.sources.raw import require_columns
from fleetcohort.sources.staging import staged

TARGET = "Churned"
#: Unrounded probability, for ranking; published scores are rounded.
RAW = "churn_raw"
#: Slices of the hash range that folds are ranked in.
FOLD_SLICES = 1024
DEFAULT_PARAMS = {
    **DEFAULTS,
    "n_estimators": 100,
    "learning_rate": 0.1,
    "max_depth": 4,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
}


# --- split and folds ------------------------------------------------------------


def with_split(
    df: DataFrame, key: str = "driver_id", share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``is_test``: a function of the key, so a driver never changes sides."""
    return df.withColumn("is_test", in_share(seed, "split", F.col(key), share))


def with_folds(df: DataFrame, folds: int, key: str = "driver_id", seed: int = SEED) -> DataFrame:
    """Adds ``fold``: rank by hash within each class, modulo ``folds``, so the folds of a class
    differ by one row at most.

    Ranks come from slices of the hash range: counts of the slices before, plus the rank inside
    the slice, so no task sorts a whole class.
    """
    drawn = df.withColumn("_draw", draw(seed, "fold", F.col(key))).withColumn(
        "_slice", F.floor(F.col("_draw") * FOLD_SLICES).cast("int")
    )
    counts = drawn.groupBy(TARGET, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(TARGET).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(TARGET, "_slice").orderBy("_draw", key)
    rank = F.col("_before") + F.row_number().over(inside) - 1
    same = drawn[TARGET].eqNullSafe(starts[TARGET]) & (drawn["_slice"] == starts["_slice"])
    ranked = drawn.join(starts, same).select(drawn["*"], "_before")
    return ranked.withColumn("fold", (rank % folds).cast("int")).drop("_draw", "_slice", "_before")


# --- model --------------------------------------------------------------------------


def positive_weight(df: DataFrame) -> float:
    """Negatives per positive: the weight of a positive row."""
    return class_balance(df, TARGET).first()["ratio"] or 1.0


def fit_churn(train: DataFrame, params: dict | None = None, seed: int = SEED) -> Ensemble:
    """Fit on rows with features, ``cluster_label`` and ``Churned``; pass a stored table.

    Missing numbers are a side of their own in every split; the cluster is a category.
    """
    require_columns(train, [*CHURN_FEATURES, TARGET])
    run = Run({**DEFAULT_PARAMS, **(params or {})})
    (model,) = boost(
        train, [run], CHURN_NUMERIC_FEATURES, "cluster_label", TARGET, positive_weight(train), seed=seed
    )
    return model


def predict_raw(df: DataFrame, model: Ensemble) -> DataFrame:
    """Adds the unrounded ``churn_raw`` and the 0/1 ``churn_prediction``."""
    require_columns(df, CHURN_FEATURES)
    scored = model.score(df, RAW)
    return scored.withColumn("churn_prediction", (F.col(RAW) > 0.5).cast("int"))


def predict(df: DataFrame, model: Ensemble) -> DataFrame:
    """Adds ``churn_probability`` (four decimals) and the 0/1 ``churn_prediction``."""
    scored = predict_raw(df, model)
    return scored.select(
        *df.columns, round_half_even(F.col(RAW), 4).alias("churn_probability"), "churn_prediction"
    )


def feature_importance(spark: SparkSession, model: Ensemble) -> DataFrame:
    """Mean gain of each feature's splits as a share of all, largest first."""
    table = spark.createDataFrame(model.importance(), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


# --- search -------------------------------------------------------------------------


def draw_settings(space: dict[str, list], draws: int, seed: int = SEED) -> list[dict]:
    """Distinct settings drawn from the full grid without building it."""
    total = prod(len(values) for values in space.values())
    picked = random.Random(seed).sample(range(total), min(draws, total))
    settings = []
    for index in picked:
        setting = {}
        for name, values in space.items():
            index, at = divmod(index, len(values))
            setting[name] = values[at]
        settings.append(setting)
    return settings


def random_search(
    train: DataFrame,
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    space: dict[str, list] = SEARCH_SPACE,
    seed: int = SEED,
) -> list[tuple[dict, float]]:
    """Mean held-out AUC per drawn setting, best first. Pass a stored table.

    All settings and folds grow side by side over one table of binned rows, a job a level.
    Settings that differ in their number of trees alone are one ensemble: its beginnings are
    scored as it grows.
    """
    settings = [{**DEFAULT_PARAMS, **s} for s in draw_settings(space, draws, seed)]
    alike: dict[tuple, list[int]] = {}
    for at, setting in enumerate(settings):
        rest = tuple(sorted((k, v) for k, v in setting.items() if k != "n_estimators"))
        alike.setdefault(rest, []).append(at)
    groups = [
        ({**settings[own[0]], "n_estimators": max(settings[i]["n_estimators"] for i in own)}, own)
        for own in alike.values()
    ]
    runs = [Run(setting, fold) for setting, _ in groups for fold in range(folds)]
    totals = [0.0] * len(settings)

    def judge(margins: DataFrame, numbers: list[int], trees: int) -> None:
        wanted = {
            run: [i for i in groups[run // folds][1] if settings[i]["n_estimators"] == trees] for run in numbers
        }
        if not any(wanted.values()):
            return
        held = ", ".join(str(runs[run].held_out) for run in numbers)
        rows = margins.selectExpr("_y", "_fold", "posexplode(margins) AS (at, margin)")
        aucs = roc_auc(rows.where(f"_fold = get(array({held}), at)"), "_y", "margin", keys=["at"])
        for row in aucs.collect():  # a row per run
            for i in wanted[numbers[row["at"]]]:
                totals[i] += row["auc"] or 0.0

    folded = with_folds(train.select("driver_id", *CHURN_FEATURES, TARGET), folds, seed=seed)
    counts = sorted({s["n_estimators"] for s in settings})
    with staged(folded, "folds") as rows:
        boost(
            rows,
            runs,
            CHURN_NUMERIC_FEATURES,
            "cluster_label",
            TARGET,
            positive_weight(rows),
            fold="fold",
            seed=seed,
            on_margins=judge,
            stops=counts,
        )
    ranked = [(setting, total / folds) for setting, total in zip(settings, totals)]
    return sorted(ranked, key=lambda entry: -entry[1])


def search_table(spark: SparkSession, ranked: list[tuple[dict, float]]) -> DataFrame:
    names = list(ranked[0][0])
    rows = [
        (rank + 1, *[str(setting[n]) for n in names], float(auc))
        for rank, (setting, auc) in enumerate(ranked)
    ]
    schema = "rank int, " + ", ".join(f"{n} string" for n in names) + ", mean_auc double"
    return spark.createDataFrame(rows, schema)


# --- training run ------------------------------------------------------------------------


@dataclass(frozen=True)
class ChurnRun:
    model: Ensemble
    params: dict
    metrics: dict[str, float]


def score_counts(df: DataFrame, model: Ensemble) -> DataFrame:
    """Rows per side, label, prediction and unrounded score: the ensemble runs once per row,
    and accuracy, report and AUC all follow from these counts."""
    scored = predict_raw(df, model)
    return scored.groupBy("is_test", TARGET, "churn_prediction", RAW).agg(
        F.count(F.lit(1)).alias("n")
    )


def _split_metrics(counts: DataFrame, name: str) -> dict[str, float]:
    report = classification_report(counts, TARGET, "churn_prediction", weight="n")
    rows = {r["row"]: r for r in report.collect()}  # five rows
    auc = roc_auc(counts, TARGET, RAW, weight="n").first()["auc"]
    return {
        f"{name}_accuracy": rows["accuracy"]["precision"],
        f"{name}_roc_auc": auc,
        **{f"{name}_{m}": rows["1"][m] for m in ("precision", "recall", "f1")},
    }


def evaluate(df: DataFrame, model: Ensemble) -> dict[str, float]:
    """Accuracy, AUC, and precision, recall and F1 of churners on both sides of the split."""
    counts = score_counts(df, model).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {
            **_split_metrics(counts.filter(~F.col("is_test")), "train"),
            **_split_metrics(counts.filter("is_test"), "test"),
        }
    finally:
        counts.unpersist()


def train_churn(
    labelled: DataFrame,
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    space: dict[str, list] = SEARCH_SPACE,
    seed: int = SEED,
) -> ChurnRun:
    """Search on the training side, refit the best setting, evaluate both sides."""
    split = with_split(labelled, seed=seed)
    train = split.filter(~F.col("is_test"))
    ranked = random_search(train, draws, folds, space, seed)
    params, cv_auc = ranked[0]
    model = fit_churn(train, params, seed)
    metrics = {**evaluate(split, model), "cv_best_roc_auc": cv_auc}
    return ChurnRun(model, {**params, "scale_pos_weight": positive_weight(train)}, metrics)


def flag_high_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("is_high_risk", F.col("churn_probability") >= HIGH_RISK_FROM)
