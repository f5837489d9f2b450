"""k-means on whole numbers: the same centres on any layout.

Standardised values are rounded to whole multiples of 1/``UNIT`` of a deviation, so distances
and sums are exact and do not depend on the order of addition. Starts follow D² sampling: a
row's chance to be the next start grows with its squared distance to the starts so far, drawn
by hash (the least of exponential keys divided by the weight), so starts are a function of keys
and values. All starts, and all numbers of clusters, advance side by side: the starts of a
smaller k are the first ones of a larger k, and a round is one aggregation over the rows. Only
sums by (run, cluster) and one row per start come to the driver. The loops over rows, runs and
centres are plain arithmetic on columns, which is compiled; array functions are not.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import uniform
from fleetcohort.functions.numeric import real
from fleetcohort.sources.staging import staged

#: Whole parts of a standard deviation.
UNIT = 1024
#: Whole parts of a feature's unit that means and deviations are computed from.
GRAIN = 1e6
ROUNDS = 20

_DISTANCE = "aggregate(zip_with(_v, centre, (a, b) -> (a - b) * (a - b)), 0L, (total, x) -> total + x)"


@dataclass(frozen=True)
class Scale:
    """Mean and deviation of each column, in grains."""

    columns: list[str]
    mean: list[float]
    deviation: list[float]

    def vector(self) -> Column:
        """A row as whole parts of deviations; missing values count as 0, a column without
        spread is 0 throughout."""
        return F.array(*self.parts())

    def parts(self) -> list[Column]:
        """The same, a column each."""
        return [
            F.rint((grains(c) - F.lit(m)) / F.lit(s) * UNIT).cast("long") if s else F.lit(0).cast("long")
            for c, m, s in zip(self.columns, self.mean, self.deviation, strict=True)
        ]

    def in_units(self, centre: list[int]) -> list[float]:
        return [
            (x / UNIT * s + m) / GRAIN for x, m, s in zip(centre, self.mean, self.deviation, strict=True)
        ]


@dataclass(frozen=True)
class Fit:
    """Centres of one run, and the sum of squared distances to them in deviations."""

    k: int
    start: int
    centres: list[list[int]]
    cost: float


def grains(column: str) -> Column:
    return F.rint(F.coalesce(real(F.col(column)), F.lit(0.0)) * GRAIN)


def fit_scale(df: DataFrame, columns: list[str]) -> Scale:
    """Means and population deviations from exact sums."""
    whole = {c: grains(c).cast("decimal(19,0)") for c in columns}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(g).alias(f"s_{c}") for c, g in whole.items()],
        *[F.sum((g * g).cast("decimal(38,0)")).alias(f"q_{c}") for c, g in whole.items()],
    ).first()
    n = row["n"] or 1
    mean = [float(int(row[f"s_{c}"] or 0)) / n for c in columns]
    square = [float(int(row[f"q_{c}"] or 0)) / n for c in columns]
    return Scale(list(columns), mean, [math.sqrt(max(q - m * m, 0.0)) for q, m in zip(square, mean, strict=True)])


def constant(value, kind: str) -> str:
    return f"from_json('{json.dumps({'v': value})}', 'v {kind}').v"


def nearest(centres: str) -> str:
    """Struct (d, c) of the nearest centre of a row with ``_v``; ties go to the smaller number."""
    return f"array_min(transform({centres}, (centre, c) -> struct({_DISTANCE} AS d, c)))"


def _each(rows: DataFrame, name: str, centres: list[list[list[int]]], dims: int, far: int) -> DataFrame:
    """Every row once for each list of centres: its number as ``name``, ``c``, the number of the
    nearest centre (ties go to the smaller), and ``d``, the squared distance to it.

    Rows have x0, x1 and so on, and xx, the sum of their squares. The least of cc - 2 x c, times the longest
    list's length, plus the centre's number, gives both; all factors are constants, so a row and
    centre cost a product and a sum a dimension. Short lists repeat their first centre at the end.
    ``far`` is the largest xx: doubles hold all numbers on the way, and are compiled to far less
    code than whole numbers with a check, unless some row is very far out.
    """
    most = max(map(len, centres))
    # |c| is |x| of some row at most, but for rounding: less than one a dimension.
    small = 4 * most * (math.isqrt(far) + dims + 1) ** 2 < 1 << 53
    mark, kind = ("D", "double") if small else ("L", "bigint")

    def constants(own: list[list[int]]) -> str:
        parts = []
        for j in range(most):
            centre = own[j] if j < len(own) else own[0]
            parts += [f"{most * sum(x * x for x in centre) + j}{mark} AS w{j}"]
            parts += [f"{-2 * most * x}{mark} AS w{j}_{d}" for d, x in enumerate(centre)]
        return ", ".join(parts)

    named = ", ".join(f"struct({i} AS {name}, {constants(own)})" for i, own in enumerate(centres))
    each = [" + ".join([f"w{j}", *(f"w{j}_{d} * y{d}" for d in range(dims))]) for j in range(most)]
    least = f"least({', '.join(each)})" if most > 1 else each[0]
    return (
        rows.selectExpr("*", *(f"CAST(x{d} AS {kind}) AS y{d}" for d in range(dims)))
        .selectExpr("*", f"inline(array({named}))")
        .selectExpr(*rows.columns, name, f"CAST({least} AS BIGINT) AS z")
        .selectExpr(*rows.columns, name, f"CAST(pmod(z, {most}L) AS INT) AS c", f"(z - pmod(z, {most}L)) DIV {most}L + xx AS d")
    )


def _starts(
    rows: DataFrame, k: int, starts: int, seed: int, dims: int, far: int
) -> list[list[list[int]]]:
    """Up to ``k`` distinct rows for each start, in the order they were drawn."""
    chosen: list[list[list[int]]] = [[] for _ in range(starts)]
    for at in range(k):
        hashed = F.md5(
            F.concat(F.lit(f"{seed}:start"), F.col("start").cast("string"), F.lit(f"-{at}:"), F.col("_key").cast("string"))
        )
        key = -F.ln(uniform(hashed))
        if at:
            drawn, key = _each(rows, "start", chosen, dims, far).where("d > 0"), key / F.col("d")
        else:
            drawn = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
        least = F.struct(key.alias("_e"), "_key", *[f"x{d}" for d in range(dims)])
        # A minimum for each start: groups would be sorted, as it is one of structs.
        found = drawn.withColumn("least", least).agg(
            *[F.expr(f"min(least) FILTER (WHERE start = {s})").alias(f"s{s}") for s in range(starts)]
        ).first()
        if all(found[f"s{s}"] is None for s in range(starts)):
            break
        for s in range(starts):
            if found[f"s{s}"] is not None:
                chosen[s].append([found[f"s{s}"][f"x{d}"] for d in range(dims)])
    return chosen


def fit_all(
    df: DataFrame, scale: Scale, ks: list[int], starts: int, seed: int, key: str = "driver_id", rounds: int = ROUNDS
) -> list[Fit]:
    """One fit per (k, start); pass a stored table."""
    dims = len(scale.columns)
    names = [f"x{d}" for d in range(dims)]
    vectors = df.select(F.col(key).alias("_key"), *[x.alias(n) for x, n in zip(scale.parts(), names, strict=True)])
    vectors = vectors.withColumn("xx", sum((F.col(n) * F.col(n) for n in names), F.lit(0).cast("long")))
    with staged(vectors, "vectors") as rows:
        far = rows.agg(F.max("xx")).first()[0] or 0
        seeds = _starts(rows, max(ks), starts, seed, dims, far)
        runs = [(k, s) for k in ks for s in range(starts)]
        centres = [[list(c) for c in seeds[s][:k]] for k, s in runs]
        if not centres[0]:
            return [Fit(k, s, [], 0.0) for k, s in runs]
        points = rows.select(*names, "xx")

        def totals(live: list[int]) -> list:
            """Per (run, cluster): rows, sums of the vectors, sum of the distances."""
            return (
                _each(points, "run", [centres[i] for i in live], dims, far)
                .groupBy("run", "c")
                .agg(
                    F.count(F.lit(1)).alias("n"),
                    F.sum("d").alias("cost"),
                    *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)],
                )
                .collect()
            )

        live = list(range(len(runs)))
        for _ in range(rounds):
            moved = set()
            for row in totals(live):
                run = live[row["run"]]
                centre = [row[f"s{i}"] // row["n"] for i in range(dims)]
                if centre != centres[run][row["c"]]:
                    centres[run][row["c"]] = centre
                    moved.add(run)
            live = sorted(moved)
            if not live:
                break
        cost = [0] * len(runs)
        for row in totals(list(range(len(runs)))):
            cost[row["run"]] += row["cost"]
    return [Fit(k, s, own, total / UNIT**2) for (k, s), own, total in zip(runs, centres, cost, strict=True)]


def best_of(fits: list[Fit]) -> Fit:
    return min(fits, key=lambda f: (f.cost, f.start))
