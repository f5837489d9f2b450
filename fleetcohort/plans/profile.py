"""Profiling tables: describe, histogram, box statistics, correlation, density.

The functions read their input more than once; pass a stored table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcohort.operators.quantiles import exact_quantiles
from fleetcohort.operators.reshape import melt, spread_struct
from fleetcohort.settings import CORRELATION_FEATURES
from fleetcohort.sources.raw import coerce_number

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
BINS = 30
DENSITY_POINTS = 200
#: Of the density's transform: bandwidths in a box, moments of a box, bandwidths a box reaches.
BOX = 0.5
TERMS = 12
REACH = 9.5


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).cast("double").alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    moments = spread_struct(stats, columns, "column")
    quartiles = exact_quantiles(melt(df, [], columns, "column", "value"), ["column"], "value", QUARTILES)
    return moments.join(quartiles, "column", "left").select(
        "column", "n", "mean", "std", "min", "q1", "median", "q3", "max"
    )


def _ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("low"),
                F.max(c).cast("double").alias("high"),
                F.count(c).alias("n"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return spread_struct(stats, columns, "column")


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Equal-width bins per column, empty bins included; the last bin is closed.

    A constant column gets a range of one unit around its value.
    """
    is_flat = F.col("low") == F.col("high")
    margin = F.when(is_flat, 0.5).otherwise(0.0)
    # One row per profiled column, so the broadcast is as small as the column list.
    ranges = (
        _ranges(df, columns)
        .filter("n > 0")
        .select("column", (F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high"))
    )
    placed = (
        melt(df, [], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(ranges), "column")
    )
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    bin_id = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy("column", bin_id.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    frame = ranges.select("column", "low", width.alias("width"), every_bin.alias("bin"))
    return frame.join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("from"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(
    df: DataFrame, columns: list[str], by: str | None = None, groups: list | None = None
) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per column, optionally per group.

    Values that are not numbers are dropped. Every value of ``by`` is a group, NULL too, unless
    ``groups`` lists those to show.
    """
    ids = [by] if by else []
    clean = df.select(*ids, *[coerce_number(c).alias(c) for c in columns])
    rows = melt(clean, ids, columns, "column", "value").filter(F.col("value").isNotNull())
    if by and groups is not None:
        rows = rows.filter(F.col(by).isin(groups))
    # Groups meet under a text that is never NULL.
    rows = rows.withColumn("_group", F.to_json(F.struct(by)) if by else F.lit(""))
    keys = ["_group", "column"]
    quartiles = exact_quantiles(rows, keys, "value", QUARTILES)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})
    value = F.col("value")
    inside = (value >= F.col("fence_low")) & (value <= F.col("fence_high"))
    return (
        rows.join(fences, keys)
        .groupBy("_group", *ids, "column", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("_group")
    )


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATION_FEATURES) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form, one pass over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{i}").alias("r")))
    stats = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return stats.select(F.inline(F.array(*entries)))


def density(df: DataFrame, columns: list[str], points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum (Scott bandwidth).

    A fast Gauss transform: values are gathered in boxes of half a bandwidth, and a box is
    described by ``TERMS`` moments of its values about its centre. Its part of the density at a
    grid point is a Hermite series in these moments, off by less than 1e-11 of its rows; points
    over ``REACH`` bandwidths away get less than 1e-19 of a row and are left out. So a value
    costs a few multiplications, whatever the number of grid points, and a box one row per
    point near it.
    """
    ranges = _ranges(df, columns).filter("n > 1 AND std > 0")
    bandwidth = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    step = (F.col("high") - F.col("low")) / (points - 1)
    frame = ranges.select("column", "low", "n", bandwidth.alias("bandwidth"), step.alias("step"))
    # One row per profiled column.
    rows = melt(df, [], columns, "column", "value").filter(F.col("value").isNotNull()).join(frame, "column")
    placed = rows.select(
        "column", ((F.col("value") - F.col("low")) / F.col("bandwidth")).alias("z")
    ).withColumn("box", F.floor(F.col("z") / BOX))
    off = F.col("z") - (F.col("box") + 0.5) * BOX
    moments = placed.withColumn("off", off).groupBy("column", "box").agg(
        *[
            F.sum(F.expr(" * ".join(["off"] * k)) if k else F.lit(1.0)).alias(f"m{k}")
            for k in range(TERMS)
        ]
    )
    # The series as a polynomial of the distance, times the kernel.
    hermite = _hermite(TERMS)
    factors = [
        sum(
            (F.col(f"m{k}") * (hermite[k][j] / math.factorial(k)) for k in range(j, TERMS) if hermite[k][j]),
            F.lit(0.0),
        ).alias(f"a{j}")
        for j in range(TERMS)
    ]
    step_z, centre = F.col("step") / F.col("bandwidth"), (F.col("box") + 0.5) * BOX
    first = F.greatest(F.lit(0), F.ceil((centre - REACH) / step_z)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((centre + REACH) / step_z)).cast("int")
    near = (
        moments.select("column", "box", *factors)
        .join(frame, "column")
        .where(first <= last)
        .withColumn("point", F.explode(F.sequence(first, last)))
        .withColumn("t", F.col("point") * step_z - centre)
    )
    series = F.col(f"a{TERMS - 1}")
    for j in reversed(range(TERMS - 1)):
        series = series * F.col("t") + F.col(f"a{j}")
    totals = near.groupBy("column", "point").agg(
        F.sum(series * F.exp(F.col("t") * F.col("t") * -0.5)).alias("total")
    )
    grid = frame.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return grid.join(totals, ["column", "point"], "left").select(
        "column",
        "point",
        (F.col("low") + F.col("step") * F.col("point")).alias("x"),
        (F.coalesce("total", F.lit(0.0)) / scale).alias("density"),
        "bandwidth",
    )


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the first Hermite polynomials (those of exp(-t*t/2))."""
    found = [[1.0], [0.0, 1.0]]
    for k in range(1, terms - 1):
        up = [0.0, *found[k]]
        down = [*found[k - 1], 0.0, 0.0]
        found.append([a - k * b for a, b in zip(up, down, strict=True)])
    return found
