"""Centroid clustering of whole-number vectors with Spark's own array functions.

A vector's components are scaled and rounded down to whole numbers, so every distance and every
new centroid is exact and does not depend on how the rows are dealt out. A round is one pass:
``zip_with`` and ``aggregate`` give the squared distance to each centroid, which stands in the
plan as a literal array; ``array_min`` of (distance, number) picks the cluster, ties going to
the smaller number; column sums by cluster, added up before the shuffle, move the centroids.
Only ``k`` rows of ``dims`` sums come to the driver in a round.

Vectors that are null, of another length, or with a null or non-finite component are left out.
Repeated rows count each. The starts are the vectors whose key has the smallest hash; equal
keys go by their components, null keys come last and are clustered like all others. With fewer
than ``k`` vectors each is a start; an empty table gives no rows. Components and distances have
to fit a 64-bit whole number. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.llm.common import stage


@dataclass(frozen=True)
class Clustering:
    """``assigned`` has a row per kept vector: key, cluster, distance; ``centroids`` by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def whole_vectors(
    vectors: DataFrame, key: str, vector: str, dims: int, scale: int
) -> DataFrame:
    """``key`` and ``v``, the components times ``scale`` rounded down, of the vectors to keep."""
    v = F.col(f"`{vector}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.coalesce((F.size(v) == dims) & ~odd, F.lit(False)))
    return kept.select(
        F.col(f"`{key}`").alias("key"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )


def starts(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose keys have the smallest hashes, in the order of the hashes."""
    place = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")).cast("binary"), 256)
    first = kept.select(place.alias("place"), "v").orderBy(F.asc_nulls_last("place"), "v").limit(k)
    return [list(row["v"]) for row in first.collect()]  # k rows


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """Struct of squared distance and number of the nearest centroid."""

    def squared(centroid: list[int]) -> Column:
        literal = F.array(*[F.lit(x) for x in centroid]).cast("array<long>")
        steps = F.zip_with(F.col(v), literal, lambda a, b: (a - b) * (a - b))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(
        F.array(
            *[
                F.struct(squared(c).alias("distance"), F.lit(i).alias("cluster"))
                for i, c in enumerate(centroids)
            ]
        )
    )


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Mean of each centroid's vectors, rounded down; a centroid without vectors stays."""
    dims = len(centroids[0])
    own = kept.select("v", nearest("v", centroids)["cluster"].alias("cluster"))
    sums = own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    )
    out = list(centroids)
    for row in sums.collect():  # a row per centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    salt: str = "1:",
    key: str = "vec_id",
    vector: str = "embedding",
) -> Clustering:
    """Cluster the vectors: starts by hash, ``rounds`` moves of the centroids, one assignment."""
    kept = stage(whole_vectors(vectors, key, vector, dims, scale), "vectors")
    centroids = starts(kept, k, salt)
    if not centroids:
        empty = kept.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty, [])
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    best = kept.select("key", nearest("v", centroids).alias("best"))
    assigned = stage(best.select("key", "best.cluster", "best.distance"), "clusters")
    return Clustering(assigned, centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """Adds each cluster's and the whole distance, and the hash of its centroid's components."""
    spark = found.assigned.sparkSession
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("distance"))
    by_cluster = {r["cluster"]: r["distance"] for r in sums.collect()}  # a row per centroid
    whole = sum(by_cluster.values())
    rows = [
        (i, total, whole, hashlib.sha256(",".join(map(str, found.centroids[i])).encode()).hexdigest())
        for i, total in sorted(by_cluster.items())
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # One row per centroid, k of them.
    return found.assigned.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:") -> str:
    """DuckDB SQL for the same rows over ``embeddings``."""
    odd = "x IS NULL OR NOT isfinite(x)"
    parts = [
        f"""kept AS (
          SELECT row_number() OVER () AS id, vec_id,
                 list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
          FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: {odd})) = 0)""",
        f"""c0 AS (
          SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, v) - 1 AS k, v AS c
          FROM kept QUALIFY k < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
          SELECT id, vec_id, v, k AS cluster, d AS distance FROM (
            SELECT kept.*, k, list_sum(list_transform(list_zip(v, c),
                              lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM kept, c{r})
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS (
              SELECT k, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (
                SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
                  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})
                  GROUP BY ALL)
                GROUP BY ALL) m ON k = cluster)""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
      SELECT vec_id, cluster::INT AS cluster, distance,
             sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
             sum(distance) OVER ()::BIGINT AS inertia,
             sha256(array_to_string(c, ',')) AS centroid_sha256
      FROM {last} JOIN c{rounds} ON k = cluster"""
