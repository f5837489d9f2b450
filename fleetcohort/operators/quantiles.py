"""Exact quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one task. Here values are counted once;
the distinct values are then cut into slices at their own approximate quantiles, so however
close together values lie, a slice holds about one ``SLICES``-th of them. The slices' counts
tell which slice holds which rank, and only the wanted slices are ordered, each by itself. The
result is exact whatever the quality of the cuts: a poor cut makes a slice longer, never wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 128


def approximate_cuts(value: str, slices: int) -> str:
    """Text of the aggregate whose array cuts the values into about equal slices."""
    steps = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    return f"percentile_approx({value}, array({steps}), {4 * slices})"


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """One row per key with one column per quantile; NULL values are ignored.

    There may be any number of keys: all joins are by key, and what is small enough to be
    broadcast is found out at run time. No keys means the whole table.
    """
    # 1. Count each value.
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )

    # 2. Slice of every value: the cuts below it.
    cuts = F.expr(approximate_cuts("_v", SLICES)).alias("_cuts")
    if keys:
        guided = counts.join(counts.groupBy(*keys).agg(cuts), keys)
    else:
        guided = counts.withColumn("_cuts", counts.agg(cuts).scalar())
    sliced = guided.withColumn("_i", F.expr("size(filter(_cuts, cut -> cut < _v))")).drop("_cuts")

    # 3. Exact rank range of every slice; at most SLICES rows per key.
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positions = [f"(_n - 1) * {float(p)!r}D" for p in quantiles.values()]
    wanted = ", ".join(f"{end}({at})" for at in positions for end in ("floor", "ceil"))
    located = (
        sliced.groupBy(*keys, "_i")
        .agg(F.sum("_c").alias("_s"))
        .withColumn("_n", F.sum("_s").over(by_key))
        .withColumn("_before", F.sum("_s").over(upto) - F.col("_s"))
        .withColumn("_ranks", F.expr(f"array_distinct(array({wanted}))"))
        .withColumn("_ranks", F.expr("filter(_ranks, r -> r >= _before AND r < _before + _s)"))
        .filter("size(_ranks) > 0")
        .drop("_s")
    )

    # 4. Order the slices that hold a wanted rank.
    inside = Window.partitionBy(*keys, "_i").orderBy("_v")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        sliced.join(located, [*keys, "_i"])
        .withColumn("_last", F.col("_before") + F.sum("_c").over(running))
        .withColumn("_rank", F.expr("explode(filter(_ranks, r -> r < _last AND r >= _last - _c))"))
    )

    # 5. Interpolate between the two neighbouring ranks.
    columns = []
    for name, at in zip(quantiles, positions):
        low = f"max(_v) FILTER (WHERE _rank = floor({at}))"
        high = f"max(_v) FILTER (WHERE _rank = ceil({at}))"
        step = f"({high} - {low}) * max({at} - floor({at}))"
        columns.append(F.expr(f"{low} + {step}").alias(name))
    return hits.groupBy(*keys).agg(*columns)
