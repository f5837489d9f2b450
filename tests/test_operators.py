"""Operators and column functions against brute force."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcohort.functions import hashing, mapping, numeric, temporal, text
from fleetcohort.operators.membership import keep_members, with_membership
from fleetcohort.operators.nearest import assign_nearest
from fleetcohort.operators.quantiles import exact_quantiles
from fleetcohort.plans import evaluation, profile

QUANTILES = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.999, "q10": 1.0}


def _check_quantiles(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", QUANTILES).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        for name, p in QUANTILES.items():
            assert got[g][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    _check_quantiles(
        spark,
        {
            "one": [5.0],
            "two": [1.0, 2.0],
            "uniform": [rng.random() for _ in range(30_000)],
            "skewed": [7.0] * 20_000 + [rng.expovariate(0.001) for _ in range(10_001)],
            "outlier": [1e300, -1e300] + [rng.gauss(0, 1) for _ in range(999)],
            "negative": [-float(i) for i in range(1000)],
        },
    )


def test_quantiles_do_not_trust_the_sketch(spark, monkeypatch):
    """With hardly any cuts the slices are long and the answer still exact."""
    from fleetcohort.operators import quantiles

    monkeypatch.setattr(quantiles, "SLICES", 2)
    rng = random.Random(2)
    _check_quantiles(spark, {"g": [rng.gauss(0, 5) for _ in range(5000)]})


def test_quantiles_of_the_whole_table_use_no_join_per_row(spark):
    df = spark.range(1, 1001).selectExpr("CAST(id AS DOUBLE) AS v")
    got = exact_quantiles(df, [], "v", {"q1": 0.25, "m": 0.5})
    assert got.first().asDict() == {"q1": 250.75, "m": 500.5}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_close_values_spread_over_slices(spark):
    """A million values in a millionth: none of the ordered slices is large, none is forced to
    be broadcast."""
    df = spark.range(1_000_000).selectExpr("1D + id / 1e12D AS v", "CAST(id % 2 AS STRING) AS g")
    got = exact_quantiles(df, ["g"], "v", QUANTILES)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    rows = {r["g"]: r for r in got.collect()}
    assert rows["0"]["q2"] == pytest.approx(1 + 499_999e-12, abs=1e-15)
    from pyspark.sql import functions as F

    from fleetcohort.operators.quantiles import SLICES

    steps = [i / SLICES for i in range(1, SLICES)]
    cuts = df.agg(F.percentile_approx("v", F.lit(steps), 4 * SLICES)).first()[0]
    slices = df.selectExpr("v").groupBy(F.expr(f"size(filter(array({', '.join(map(repr, cuts))}), c -> c < v))")).count()
    assert max(r["count"] for r in slices.collect()) < 4 * 1_000_000 / SLICES


def test_quantiles_skip_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", {"m": 0.5}).first()["m"] == 2.0


def test_histogram_equals_numpy(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["n"] for r in profile.histogram(df, ["x"]).orderBy("bin").collect()]
    assert got == list(np.histogram(values, bins=30)[0])


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    rows = profile.histogram(df, ["x"], bins=3).orderBy("bin").collect()
    assert [r["n"] for r in rows] == list(np.histogram([2.0] * 5, bins=3)[0])


def test_density_equals_plain_sums(spark):
    rng = random.Random(8)
    wide = [rng.gauss(0, 1) for _ in range(400)] + [rng.expovariate(0.01) for _ in range(80)] + [5000.0]
    rows = [(x, float(i % 3), 7.0, None) for i, x in enumerate(wide)] + [(None, None, 7.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, flat double, none double").repartition(5)
    got = profile.density(df, ["x", "y", "flat", "none"]).collect()
    assert {r["column"] for r in got} == {"x", "y"} and len(got) == 400
    for column, values in (("x", wide), ("y", [float(i % 3) for i in range(len(wide))])):
        values = np.array(values)
        h = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 200)
        wanted = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
        own = {r["point"]: r["density"] for r in got if r["column"] == column}
        assert max(abs(own[i] - wanted[i]) * h for i in range(200)) < 1e-11


def test_density_integrates_to_one(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(2000)], "x double")
    rows = profile.density(df, ["x"]).orderBy("point").collect()
    area = np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows])
    assert len(rows) == 200
    assert area == pytest.approx(1.0, abs=0.01)


def test_box_coerces_text_and_finds_outliers(spark):
    values = ["1", "2", "3", "4", "100", "oops", None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    row = profile.box_stats(df, ["x"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (1.0, 4.0, 1, 5)


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.0, 5.0), (4.0, None, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 6])[0, 1])
    assert got[("a", "c")] == got[("c", "a")] == pytest.approx(np.corrcoef([2, 3, 4], [1, 5, 2])[0, 1])


def test_nearest_takes_the_lowest_label_on_ties(spark):
    centroids = spark.createDataFrame([(1, 1.0), (0, -1.0), (2, 9.0)], "label int, x double")
    df = spark.createDataFrame([(0.0,), (0.5,), (8.0,)], "x double")
    got = [r["label"] for r in assign_nearest(df, centroids, "label", ["x"]).orderBy("x").collect()]
    assert got == [0, 1, 2]


def test_membership(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    members = spark.createDataFrame([(2,), (2,), (9,)], "k int")
    flags = {r["k"]: r["hit"] for r in with_membership(df, members, "k", "hit").collect()}
    assert flags == {1: False, 2: True, 3: False}
    assert [r["k"] for r in keep_members(df, members, "k").collect()] == [2]


def _one(spark, column, schema="x double", value=0.0):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value", [2.5, 3.5, -2.5, 0.125, 1.005, 71951.90275])
def test_rounding_equals_numpy(spark, value):
    for places in (0, 2, 4):
        got = _one(spark, numeric.round_half_even(F.col("x"), places), value=value)
        assert got == np.round(value, places)


def test_clip_keeps_null(spark):
    assert _one(spark, numeric.clip(F.col("x"), 0, 1), value=None) is None
    assert _one(spark, numeric.clip(F.col("x"), 0, 1), value=7.0) == 1.0


def test_safe_ratio(spark):
    assert _one(spark, numeric.safe_ratio(F.lit(1), F.col("x"))) is None
    assert _one(spark, numeric.safe_ratio(F.lit(1), F.col("x")), value=4.0) == 0.25


@pytest.mark.parametrize(
    "share,percent", [(0.999, 99), (0.0, 0), (1.7, 100), (0.28999, 28)]
)
def test_percent_truncates(spark, share, percent):
    assert _one(spark, numeric.truncated_percent(F.col("x")), value=share) == percent


def test_boundary_differences(spark):
    def diff(fn, a, b):
        df = spark.createDataFrame(
            [(datetime.fromisoformat(a), datetime.fromisoformat(b))], "a timestamp_ntz, b timestamp_ntz"
        )
        return df.select(fn(F.col("a"), F.col("b"))).first()[0]

    day = "2024-06-05 "
    assert diff(temporal.hours_between, day + "10:59:00", day + "11:01:00") == 1
    assert diff(temporal.hours_between, day + "11:01:00", day + "11:59:59") == 0
    assert diff(temporal.hours_between, day + "11:01:00", day + "10:59:00") == -1
    assert diff(temporal.seconds_between, day + "10:59:00.900000", day + "10:59:01.100000") == 1


def test_text(spark):
    assert _one(spark, text.percent_text(F.col("x")), value=0.31249) == "31.2%"
    assert _one(spark, text.money_text(F.col("x")), value=12.5) == "$12.50"
    assert _one(spark, text.title_label(F.col("x")), "x string", " trip_utilization_rate ") == (
        "Trip Utilization Rate"
    )
    assert _one(spark, text.short_id(F.col("x")), "x string", "0123456789") == "01234567"


@pytest.mark.parametrize("p,band", [(0.3499, "low"), (0.35, "medium"), (0.5499, "medium"), (0.55, "high")])
def test_risk_bands(spark, p, band):
    assert _one(spark, mapping.risk_band(F.col("x")), value=p) == band


def test_unmapped_code_is_null(spark):
    assert _one(spark, mapping.map_codes(F.col("x"), {1: "a"}), "x int", 2) is None


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(5000)
    u = hashing.draw(7, "s", F.col("id")).alias("u")
    a = {r["id"]: r["u"] for r in ids.repartition(1).select("id", u).collect()}
    b = {r["id"]: r["u"] for r in ids.repartition(13).select("id", u).collect()}
    assert a == b
    assert 0.47 < sum(a.values()) / 5000 < 0.53
    z = ids.select(hashing.standard_normal(7, "z", F.col("id")).alias("z"))
    row = z.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(row["m"]) < 0.05 and abs(row["s"] - 1) < 0.05


def test_auc_equals_pair_counting(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    df = spark.createDataFrame(rows, "y int, s double")
    got = evaluation.roc_auc(df, "y", "s").first()
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert (got["positives"], got["negatives"]) == (len(pos), len(neg))


def test_auc_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(6)
    rows = [(float(rng.randint(0, 1)), round(rng.random(), 3)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "y double, s double")
    theirs = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert evaluation.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(theirs)


def test_auc_without_positives_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first()["auc"] is None


def test_report_on_a_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rows = {r["row"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert rows["0"]["recall"] == 1.0
    assert rows["1"]["precision"] == 0.0 and rows["1"]["support"] == 0
    assert rows["accuracy"]["f1"] == 1.0
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_epoch_text_is_exact_for_micros(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:07.179575' AS ts")
    got = df.select(temporal.epoch_seconds(F.col("ts"))).first()[0]
    assert got == 1704067207 and math.isclose(got % 60, 7)


def test_box_groups_keep_null_and_unlisted_values(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), ("b", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["median"], r["n"]) for r in profile.box_stats(df, ["x"], "g").collect()}
    assert got == {"a": (2.0, 2), None: (5.0, 1), "b": (7.0, 1)}
    one = profile.box_stats(df, ["x"], "g", ["b"]).collect()
    assert [r["g"] for r in one] == ["b"]


def test_auc_compares_unrounded_scores(spark):
    df = spark.createDataFrame([(1, 0.10000002), (0, 0.10000001)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first()["auc"] == 1.0
