"""k-means on whole numbers: layout, planted clusters, awkward tables."""

from __future__ import annotations

import random

from fleetcohort.plans import kmeans, segments
from fleetcohort.settings import CLUSTERING_FEATURES
from fleetcohort.sources.staging import stage

SCHEMA = "driver_id string, " + ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)


def table_of(spark, n=240, groups=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = i % groups
        values = [10.0 * ((centre >> j % 2) & 1) + rng.gauss(0, 0.2) for j in range(len(CLUSTERING_FEATURES))]
        if i % 40 == 7:
            values[5] = None
        if i % 40 == 9:
            values[5] = float("nan")
        rows.append((f"d{i}", *values))
    return stage(spark.createDataFrame(rows, SCHEMA), "clusters")


def test_layout_does_not_matter(spark):
    df = table_of(spark)
    models = [segments.fit_segments(stage(df.repartition(n), "layout"), starts=3) for n in (1, 8, 64)]
    assert models[0].to_json() == models[1].to_json() == models[2].to_json()
    assert segments.SegmentModel.from_json(models[0].to_json()) == models[0]


def test_planted_clusters_are_found(spark):
    labelled = segments.fit_segments(table_of(spark)).transform(table_of(spark))
    pairs = {(int(r["driver_id"][1:]) % 4, r["cluster_label"]) for r in labelled.collect()}
    assert len(pairs) == 4 and len({c for _, c in pairs}) == 4


def test_costs_equal_plain_sums(spark):
    df = table_of(spark, n=60)
    scale = kmeans.fit_scale(df, CLUSTERING_FEATURES)
    vectors = [r["v"] for r in df.select(scale.vector().alias("v")).collect()]
    for fit in kmeans.fit_all(df, scale, [2, 3], starts=2, seed=7):
        assert len(fit.centres) == fit.k
        total = sum(min(sum((a - b) ** 2 for a, b in zip(v, c)) for c in fit.centres) for v in vectors)
        assert fit.cost == total / kmeans.UNIT**2


def test_fewer_points_than_clusters_and_empty(spark):
    same = stage(spark.createDataFrame([(f"d{i}", *[1.0] * 6) for i in range(5)], SCHEMA), "same")
    model = segments.fit_segments(same, k=4, starts=2)
    assert len(model.centres) == 1
    assert {r["cluster_label"] for r in model.transform(same).collect()} == {0}
    two = stage(spark.createDataFrame([("a", *[1.0] * 6), ("b", *[2.0] * 6)], SCHEMA), "two")
    assert len(segments.fit_segments(two, k=4, starts=2).centres) == 2
    empty = stage(spark.createDataFrame([], SCHEMA), "empty")
    assert segments.fit_segments(empty, k=4, starts=2).centres == []


def test_nearest_centres_by_plain_arithmetic(spark):
    """Ties, short lists and rows far out: the same number and distance as one by one."""
    rng = random.Random(3)
    for size in (3000, 10**8):  # doubles, then whole numbers
        points = [[rng.randrange(-size, size) for _ in range(3)] for _ in range(200)] + [[0, 0, 0], [size, 0, 0]]
        lists = [points[:1], [points[4], points[4], points[7], points[9]], [[0, 0, 0], [2, 0, 0]], points[20:28]]
        rows = spark.createDataFrame([(*p, sum(x * x for x in p)) for p in points], "x0 long, x1 long, x2 long, xx long")
        far = max(sum(x * x for x in p) for p in points)
        found = kmeans._each(rows, "run", lists, 3, far)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and ("as double" in plan) == (size == 3000)
        got = sorted((r["run"], r["x0"], r["x1"], r["x2"], r["c"], r["d"]) for r in found.collect())
        want = []
        for i, own in enumerate(lists):
            for p in points:
                d, c = min((sum((a - b) ** 2 for a, b in zip(p, centre)), c) for c, centre in enumerate(own))
                want.append((i, *p, c, d))
        assert got == sorted(want)
