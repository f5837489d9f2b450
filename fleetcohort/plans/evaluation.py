"""Classifier evaluation on (label, prediction, score) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcohort.operators.quantiles import approximate_cuts

#: Slices of the scores that are ordered one by one.
SCORE_SLICES = 128


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives and their ratio: the weight of a positive row."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).withColumn("ratio", F.col("negatives").cast("double") / F.nullif("positives", F.lit(0)))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All four cells, empty ones included, from one aggregation."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counts = df.agg(
        *[
            F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"c{a}{p}")
            for a, p in cells
        ]
    )
    rows = [
        F.struct(
            F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n")
        )
        for a, p in cells
    ]
    return counts.select(F.inline(F.array(*rows)))


def _rows(condition: Column, weight: str | None) -> Column:
    """Rows that meet the condition; ``weight`` names a count if rows stand for several."""
    n = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")


def classification_report(
    df: DataFrame, label: str, prediction: str, weight: str | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    actual, predicted = F.col(label), F.col(prediction)
    counts = df.agg(
        *[_rows((actual == c) & (predicted == c), weight).alias(f"hit{c}") for c in (0, 1)],
        *[_rows(actual == c, weight).alias(f"sup{c}") for c in (0, 1)],
        *[_rows(predicted == c, weight).alias(f"pred{c}") for c in (0, 1)],
    )

    def ratio(a, b):
        return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    derived = counts
    for c in (0, 1):
        derived = derived.withColumns(
            {
                f"p{c}": ratio(F.col(f"hit{c}"), F.col(f"pred{c}")),
                f"r{c}": ratio(F.col(f"hit{c}"), F.col(f"sup{c}")),
            }
        ).withColumn(f"f{c}", ratio(F.col(f"p{c}") * F.col(f"r{c}") * 2, F.col(f"p{c}") + F.col(f"r{c}")))
    total = F.col("sup0") + F.col("sup1")
    accuracy = ratio(F.col("hit0") + F.col("hit1"), total)

    def line(name, p, r, f, support):
        return F.struct(
            F.lit(name).alias("row"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.alias("support"),
        )

    def macro(m):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m):
        return ratio(F.col(f"{m}0") * F.col("sup0") + F.col(f"{m}1") * F.col("sup1"), total)

    lines = [
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("sup0")),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("sup1")),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", macro("p"), macro("r"), macro("f"), total),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ]
    return derived.select(F.inline(F.array(*lines)))


def roc_auc(
    df: DataFrame, label: str, score: str, weight: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve, ties averaged: one row (positives, negatives, auc), or one for
    each value of ``keys``.

    Scores are compared unrounded and may have any range. They are counted per value first, then
    ordered inside slices cut at the scores' own quantiles, so that scores that lie close together
    still spread over the slices; only the slices' totals are ordered in one task (a key's
    ``SCORE_SLICES`` rows). A NULL or NaN score is left out.
    """
    keys = list(keys)
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    by_score = scored.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        _rows(F.col(label) == 1, weight).alias("pos"), _rows(F.col(label) == 0, weight).alias("neg")
    )
    cuts = F.expr(approximate_cuts("_score", SCORE_SLICES)).alias("_cuts")
    if keys:
        guided = by_score.join(by_score.groupBy(*keys).agg(cuts), keys)
    else:
        guided = by_score.withColumn("_cuts", by_score.agg(cuts).scalar())
    sliced = guided.withColumn("_slice", F.expr("size(filter(_cuts, c -> c < _score))")).drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("neg").alias("_neg"))
    starts = totals.select(
        *keys, "_slice", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_before")
    )
    below = Window.partitionBy(*keys, "_slice").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_inside", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    ranked = ranked.join(starts, [*keys, "_slice"]).withColumn(
        "neg_below", F.col("_inside") + F.col("_before")
    )
    # A positive beats every negative below it and half of those it ties with.
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return (
        ranked.groupBy(*keys)
        .agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("wins"))
        .select(*keys, "positives", "negatives", (F.col("wins") / F.nullif(pairs, F.lit(0.0))).alias("auc"))
    )
