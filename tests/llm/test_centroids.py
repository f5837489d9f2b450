"""Centroid clustering against plain whole-number arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcohort.llm import centroids, queries
from tests.oracle import connect, difference

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, dims, scale=64):
    kept = [
        (key, [math.floor(float(np.float32(x)) * scale) for x in v])
        for key, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]

    def place(row):
        key, v = row
        return (1, "", v) if key is None else (0, hashlib.sha256(f"1:{key}".encode()).hexdigest(), v)

    centres = [v for _, v in sorted(kept, key=place)[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(best(v)[1], []).append(v)
        centres = [
            [sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else c for i, c in enumerate(centres)
        ]
    out = [(key, *reversed(best(v))) for key, v in kept]
    return sorted(out, key=repr), centres


def assert_equal(spark, df, rows, k=5, rounds=3, dims=4):
    found = centroids.cluster_vectors(df, k=k, rounds=rounds, dims=dims)
    wanted, centres = plain(rows, k, rounds, dims)
    got = sorted(((r["key"], r["cluster"], r["distance"]) for r in found.assigned.collect()), key=repr)
    assert got == wanted
    assert found.centroids == centres
    table = centroids.with_inertia(found).collect()
    assert len(table) == len(wanted)
    for r in table:
        assert r["inertia"] == sum(d for _, _, d in wanted)
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"])
        text = ",".join(map(str, centres[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (n, 4)).astype(np.float32))]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *rows_of(60),
        (3, [0.5, 0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5, 0.5]), (3, [0.1, 0.5, 0.5, 0.5]),  # repeated keys
        (None, [0.0, -0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]),
        (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0] * 5), (104, [1.0] * 5_000),
        (105, [nan, 0.0, 0.0, 0.0]), (106, [inf, 0.0, 0.0, 0.0]), (107, [0.0, -inf, 0.0, 0.0]),
        (108, [None, 0.0, 0.0, 0.0]), (109, [1e6, -1e6, 1e-20, -1e-20]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "v", "place", "cluster", "distance", "best", "n", "s0"):
        df = df.withColumn(name, F.lit("clash"))
    assert_equal(spark, df, rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)]
    assert_equal(spark, spark.createDataFrame(rows, SCHEMA), rows, k=8)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA)
    if n:
        assert_equal(spark, df, rows)
    else:
        assert centroids.with_inertia(centroids.cluster_vectors(df, dims=4)).count() == 0


def test_partitions_do_not_matter(spark):
    rows = rows_of(200, seed=1)
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7, 40):
        assert_equal(spark, df.repartition(n), rows)


def test_double_and_whole_number_columns(spark):
    rows = [(i, [float(i), float(-i), 1.0, 2.0]) for i in range(20)]
    for kind in ("double", "int", "long"):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        assert_equal(spark, df, rows)


def test_query_equals_its_sql(spark, tiny):
    text = queries.ORACLE["op13_centroids"]
    assert difference(queries.op13_centroids(spark, tiny), connect(tiny), text) is None
