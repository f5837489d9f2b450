"""Boosted trees against trees grown row by row in plain Python, and the staged search."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import draw
from fleetcohort.plans import boosting, churn
from fleetcohort.plans.evaluation import roc_auc
from fleetcohort.settings import CHURN_FEATURES, CHURN_NUMERIC_FEATURES
from fleetcohort.sources.staging import stage

FEATURES = ["a", "b", "c"]
SCHEMA = "driver_id string, a double, b double, c double, cluster_label int, Churned int"
SETTINGS = {**boosting.DEFAULTS, "n_estimators": 4, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.8}


def rows_of(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.choice([0.0, 0.5, 1.0, None, float("nan")])
        c, k = (None if rng.random() < 0.3 else rng.random() * 1000), rng.choice([0, 1, 2, 3, None])
        odds = 2 * a + (1.5 if k == 2 else 0) - (1 if c is None else 0)
        out.append((f"d{i}", a, b, c, k, int(rng.random() < 1 / (1 + math.exp(-odds)))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return stage(spark.createDataFrame(rows_of(), SCHEMA), "boost")


def grow(df, runs, ratio=1.5, **more):
    return boosting.boost(df, runs, FEATURES, "cluster_label", "Churned", ratio, **more)


def plain_trees(rows, draws, settings, ratio, cuts, seed=42):
    """The same definition, row by row."""
    parts = float(1 << 24)

    def place(row):
        out = []
        for value, ends in zip(row[1:4], cuts, strict=True):
            missing = value is None or math.isnan(value)
            out.append(-1 if missing else sum(c < round(value * 1e6) for c in ends))
        return [*out, -1 if row[4] is None else row[4]]

    bins = [place(r) for r in rows]
    margins, trees = [0.0] * len(rows), []
    for t in range(settings["n_estimators"]):
        grad = []
        for row, margin in zip(rows, margins, strict=True):
            p, w = 1 / (1 + math.exp(-margin)), ratio if row[5] else 1.0
            grad.append((math.floor(w * (p - row[5]) * parts + 0.5), math.floor(w * p * (1 - p) * parts + 0.5)))
        columns = boosting.chosen_columns(4, settings["colsample_bytree"], t, seed)
        sampled = [i for i in range(len(rows)) if draws[t][rows[i][0]] < settings["subsample"]]
        nodes = [1] * len(rows)
        splits = {}
        for level in range(settings["max_depth"]):
            for node in range(1 << level, 2 << level):
                own = [i for i in sampled if nodes[i] == node]

                def worth(ids):
                    g, h = sum(grad[i][0] for i in ids) / parts, sum(grad[i][1] for i in ids) / parts
                    return g * g / (h + settings["reg_lambda"]) if ids else 0.0

                best = None
                for f in columns:
                    for at in sorted({bins[i][f] for i in own}):
                        for to_left in (False, True):
                            if f == 3 and to_left:
                                continue
                            left = [i for i in own if goes_left(bins[i], f, at, to_left)]
                            right = [i for i in own if i not in set(left)]
                            if any(sum(grad[i][1] for i in side) < parts for side in (left, right)):
                                continue
                            gain = 0.5 * (worth(left) + worth(right) - worth(own)) - settings["gamma"]
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, at, to_left)
                if best:
                    splits[node] = best
            for i in range(len(rows)):
                if nodes[i] in splits and nodes[i] >= 1 << level:
                    _, f, at, to_left = splits[nodes[i]]
                    nodes[i] = 2 * nodes[i] + (not goes_left(bins[i], f, at, to_left))
        values = {}
        for node in set(nodes):
            own = [i for i in sampled if nodes[i] == node]
            g, h = sum(grad[i][0] for i in own) / parts, sum(grad[i][1] for i in own) / parts
            values[node] = -g / (h + settings["reg_lambda"]) * settings["learning_rate"]
        margins = [m + values[node] for m, node in zip(margins, nodes, strict=True)]
        trees.append(splits)
    return trees, margins


def goes_left(bins, f, at, to_left):
    if f == 3:
        return bins[f] == at
    return to_left if bins[f] < 0 else bins[f] <= at


def test_trees_equal_those_grown_row_by_row(spark, table):
    (model,) = grow(table, [boosting.Run(SETTINGS)])
    rows = [tuple(r) for r in table.collect()]
    draws = [
        {r["driver_id"]: r["u"] for r in table.select("driver_id", draw(42, f"rows{t}", F.col("driver_id")).alias("u")).collect()}
        for t in range(SETTINGS["n_estimators"])
    ]
    trees, margins = plain_trees(rows, draws, SETTINGS, 1.5, model.cuts)
    for tree, splits in zip(model.trees, trees, strict=True):
        found = {n: (f, tree.bin[n], tree.left[n]) for n, f in enumerate(tree.feature) if f >= 0}
        assert found == {n: s[1:] for n, s in splits.items()}
    scored = {r["driver_id"]: r["p"] for r in model.score(table, "p").select("driver_id", "p").collect()}
    for row, margin in zip(rows, margins, strict=True):
        assert scored[row[0]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_layout_does_not_matter(spark, table):
    models = [grow(stage(table.repartition(n), "layout"), [boosting.Run(SETTINGS)])[0] for n in (1, 8, 33)]
    assert models[0].to_json() == models[1].to_json() == models[2].to_json()


def test_runs_side_by_side_equal_runs_alone(table):
    other = {**SETTINGS, "n_estimators": 2, "max_depth": 2, "reg_lambda": 5.0, "gamma": 0.5, "subsample": 1.0}
    both = grow(table, [boosting.Run(SETTINGS), boosting.Run(other)])
    alone = [grow(table, [boosting.Run(s)])[0] for s in (SETTINGS, other)]
    for got, wanted in zip(both, alone, strict=True):
        assert len(got.trees) == len(wanted.trees)
        for a, b in zip(got.trees, wanted.trees, strict=True):
            n = len(b.feature)
            assert a.feature[:n] == b.feature and a.value[:n] == b.value and a.bin[:n] == b.bin


def test_model_survives_text_and_node_table(spark, table):
    (model,) = grow(table, [boosting.Run(SETTINGS)])
    again = boosting.Ensemble.from_json(model.to_json())
    assert again == model
    nodes = model.node_table(spark)
    assert nodes.where("tree = 0 AND node = 1").count() == 1
    # Walk the table by joins: numbers up to the threshold go left.
    at = table.crossJoin(spark.range(len(model.trees)).selectExpr("CAST(id AS INT) AS tree")).withColumn("node", F.lit(1))
    for _ in range(SETTINGS["max_depth"]):
        value = F.expr("CASE feature WHEN 'a' THEN nanvl(a, NULL) WHEN 'b' THEN nanvl(b, NULL) WHEN 'c' THEN nanvl(c, NULL) END")
        left = F.when(F.col("feature") == "cluster_label", F.coalesce(F.col("cluster_label"), F.lit(-1)) == F.col("threshold")).otherwise(
            F.when(value.isNull(), F.col("missing_left")).otherwise(F.coalesce(F.rint(value * 1e6) / 1e6 <= F.col("threshold"), F.lit(False)))
        )
        step = nodes.select("tree", "node", "feature", "threshold", "missing_left")
        at = at.join(step, ["tree", "node"]).select(
            *table.columns, "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node")
        )
    walked = at.join(nodes, ["tree", "node"]).groupBy("driver_id").agg(F.sum("value").alias("margin"))
    scored = model.score(table, "p").join(walked, "driver_id")
    assert scored.where("abs(p - 1 / (1 + exp(-margin))) > 1e-9").count() == 0


def test_one_class_empty_and_missing_features(spark):
    rows = [(f"d{i}", None, None, None, None, 0) for i in range(20)]
    df = stage(spark.createDataFrame(rows, SCHEMA), "one")
    (model,) = grow(df, [boosting.Run({**SETTINGS, "n_estimators": 1})], ratio=1.0)
    assert all(f < 0 for f in model.trees[0].feature) and model.cuts == [[], [], []]
    assert all(r["p"] < 0.5 for r in model.score(df, "p").collect())
    empty = stage(spark.createDataFrame([], SCHEMA), "empty")
    (model,) = grow(empty, [boosting.Run({**SETTINGS, "n_estimators": 1})])
    assert model.score(df, "p").first()["p"] == 0.5


def test_auc_of_grouped_and_concentrated_scores(spark):
    rng = random.Random(5)
    rows = [(k, int(rng.random() < 0.4), rng.choice([1e-7 * rng.random(), -3.0, 40.0])) for k in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    got = {r["k"]: r for r in roc_auc(df, "y", "s", keys=["k"]).collect()}
    for k in range(3):
        pos = [s for g, y, s in rows if g == k and y]
        neg = [s for g, y, s in rows if g == k and not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[k]["auc"] == pytest.approx(wins / len(pos) / len(neg))
        alone = roc_auc(df.where(F.col("k") == k), "y", "s").first()
        assert (alone["positives"], alone["negatives"]) == (len(pos), len(neg))
        assert alone["auc"] == pytest.approx(got[k]["auc"])


def planted_drivers(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        values = [rng.random() for _ in CHURN_NUMERIC_FEATURES]
        y = int((values[0] > 0.5) != (values[1] > 0.5)) if rng.random() < 0.97 else 0
        rows.append((f"d{i}", *values, i % 4, y))
    schema = "driver_id string, " + ", ".join(f"{c} double" for c in CHURN_NUMERIC_FEATURES) + ", cluster_label int, Churned int"
    return stage(spark.createDataFrame(rows, schema), "planted")


def test_search_finds_a_planted_label_and_scores_prefixes(spark):
    df = planted_drivers(spark)
    space = {"n_estimators": [2, 6], "learning_rate": [0.5], "max_depth": [1, 3]}
    ranked = churn.random_search(df, draws=4, folds=2, space=space)
    assert [s["max_depth"] for s, _ in ranked[:2]] == [3, 3]
    assert ranked[0][1] > 0.9 and ranked[-1][1] < 0.7
    # A prefix of a longer ensemble scores as the shorter ensemble fitted alone.
    setting, auc = next((s, a) for s, a in ranked if s["n_estimators"] == 2 and s["max_depth"] == 3)
    folded = stage(churn.with_folds(df.select("driver_id", *CHURN_FEATURES, "Churned"), 2), "folded")
    aucs = []
    for fold in range(2):
        run = boosting.Run(setting, fold)
        (model,) = boosting.boost(
            folded, [run], CHURN_NUMERIC_FEATURES, "cluster_label", "Churned", churn.positive_weight(folded), fold="fold"
        )
        aucs.append(roc_auc(model.score(folded.where(F.col("fold") == fold), "p"), "Churned", "p").first()["auc"])
    assert auc == pytest.approx(sum(aucs) / 2, abs=1e-9)
