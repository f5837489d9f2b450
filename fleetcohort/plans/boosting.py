"""Gradient-boosted trees for a 0/1 label, grown on histograms of whole numbers.

Features are binned once at their exact quantiles. A level of a tree is one aggregation: the
gradients and hessians of the logistic loss, as whole multiples of 2**-24, are added up by
(run, node, feature, bin), and the best split of each node follows from prefix sums over its
bins. Whole-number sums make the ensemble a function of keys and values: it is the same on any
layout, and any engine that adds whole numbers grows the same trees.

Several runs (settings, held-out fold) grow side by side: they share the rows, the bins and
every job. Only the best split of each node (at most 2**depth a run) comes to the driver. What
a run has learned is kept as one margin per row; the table of margins is written every few
trees, which cuts the lineage and survives a lost executor.

A missing number goes to the side that gains more. The last feature is a category: a split
takes one category to the left. A node is split if the gain exceeds ``gamma`` and both sides
hold a hessian of at least ``LEAST_HESSIAN``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.functions.hashing import draw
from fleetcohort.functions.numeric import real
from fleetcohort.operators.quantiles import exact_quantiles
from fleetcohort.sources.staging import staged

#: Gradients are whole multiples of one part in so many.
PARTS = float(1 << 24)
LEAST_HESSIAN = 1.0
#: A split has to gain more than this, as well as ``gamma``.
LEAST_GAIN = 1e-6
BINS = 32
#: Features are compared after rounding to this part of a unit.
GRAIN = 1e6
#: Trees between two writes of the margins.
TREES_APART = 10

#: Library defaults of the original classifier, with its usual number of trees.
DEFAULTS = {
    "n_estimators": 100,
    "learning_rate": 0.3,
    "max_depth": 6,
    "gamma": 0.0,
    "subsample": 1.0,
    "colsample_bytree": 1.0,
    "reg_lambda": 1.0,
}

_TREE = "struct<feature: array<int>, bin: array<int>, left: array<boolean>, value: array<double>>"


@dataclass
class Tree:
    """Nodes by heap position: children of n are 2n and 2n+1, the root is 1, 0 is unused.

    ``feature`` is -1 where a node is not split; every node that rows reach has a ``value``.
    """

    feature: list[int]
    bin: list[int]
    left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def literal(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "gain"}


@dataclass
class Ensemble:
    """A fitted model: numeric features with their cut points, one category, trees."""

    features: list[str]
    category: str
    cuts: list[list[float]]
    settings: dict
    trees: list[Tree] = field(default_factory=list)

    def bins(self) -> Column:
        return binned(self.features, self.category, self.cuts)

    def margin(self, first: int | None = None) -> Column:
        """Log-odds of a row that has its ``_bins``, from all trees or the first few."""
        trees = self.trees if first is None else self.trees[:first]
        if not trees:
            return F.lit(0.0)
        return F.expr(_added(_literal([t.literal() for t in trees], f"array<{_TREE}>"), _depth(trees)))

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the probability of label 1 as ``name``."""
        probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return df.withColumn("_bins", self.bins()).withColumn(name, probability).drop("_bins")

    def importance(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits, as a share of all features' means."""
        names = [*self.features, self.category]
        gains: list[list[float]] = [[] for _ in names]
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain, strict=True):
                if feature >= 0:
                    gains[feature].append(gain)
        means = [sum(g) / len(g) if g else 0.0 for g in gains]
        whole = sum(means)
        return [(name, mean / whole if whole else 0.0) for name, mean in zip(names, means, strict=True)]

    def node_table(self, spark: SparkSession) -> DataFrame:
        """A row per node: where it splits (numbers up to ``threshold`` go left; a category
        equal to ``threshold`` does), its value and gain."""
        names, rows = [*self.features, self.category], []
        for number, tree in enumerate(self.trees):
            reached = {1}
            for node, feature in enumerate(tree.feature):
                if node not in reached:
                    continue
                name, threshold = None, None
                if feature >= 0:
                    reached |= {2 * node, 2 * node + 1}
                    name = names[feature]
                    if feature == len(self.features):
                        threshold = float(tree.bin[node])
                    elif tree.bin[node] >= 0:
                        # No value lies between the bin's end and the next cut point.
                        ends = self.cuts[feature]
                        threshold = ends[tree.bin[node]] / GRAIN if tree.bin[node] < len(ends) else None
                rows.append((number, node, name, threshold, tree.left[node], tree.value[node], tree.gain[node]))
        schema = "tree int, node int, feature string, threshold double, missing_left boolean, value double, gain double"
        return spark.createDataFrame(rows, schema)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        parts = json.loads(text)
        return cls(**{**parts, "trees": [Tree(**t) for t in parts["trees"]]})


@dataclass(frozen=True)
class Run:
    """One ensemble to grow: its settings, and the fold it does not learn from."""

    settings: dict
    held_out: int = -1


# --- columns -------------------------------------------------------------------------------


def grains(name: str) -> Column:
    """A feature as a whole number of grains; NULL and NaN are NULL."""
    return F.rint(real(F.col(name)) * GRAIN)


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Exact quantiles of each feature, in grains; none for a feature without values."""
    melted = df.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), grains(c).alias("value")) for i, c in enumerate(features)]))
    )
    wanted = {f"q{i:04d}": i / bins for i in range(1, bins)}
    # Rows: one per feature.
    found = {r["feature"]: r for r in exact_quantiles(melted, ["feature"], "value", wanted).collect()}
    return [[found[i][q] for q in wanted] if i in found else [] for i in range(len(features))]


def binned(features: list[str], category: str, cuts: list[list[float]]) -> Column:
    """Bin of every feature: the cut points below its value, -1 if it is missing."""
    ends = F.expr(_literal(cuts, "array<array<double>>"))

    def place(i: int, name: str) -> Column:
        value = grains(name)
        passed = F.size(F.filter(F.get(ends, F.lit(i)), lambda cut: cut < value))
        return F.when(value.isNull(), -1).otherwise(passed)

    numbers = [place(i, name) for i, name in enumerate(features)]
    return F.array(*numbers, F.coalesce(F.col(category).cast("int"), F.lit(-1)))


# What follows is text of expressions: a level is planned anew for every tree, and text is
# planned several times faster than the same columns built one by one.


def _literal(value, kind: str) -> str:
    """A nested constant, read once while the query is planned."""
    return f"from_json('{json.dumps({'v': value})}', 'v {kind}').v"


def _depth(trees: list[Tree]) -> int:
    return max(len(t.feature) for t in trees).bit_length() - 2


def _node(tree: str, depth: int) -> str:
    """Where a row, given by ``_bins``, ends in a tree, or has got to so far."""
    feature, at = f"get({tree}.feature, node)", f"get({tree}.bin, node)"
    own = f"get(_bins, {feature})"
    return f"""aggregate(sequence(1, {max(depth, 1)}), 1, (node, step) -> CASE
        WHEN {feature} < 0 THEN node
        WHEN CASE WHEN {feature} = size(_bins) - 1 THEN {own} = {at}
                  WHEN {own} < 0 THEN get({tree}.left, node)
                  ELSE {own} <= {at} END THEN 2 * node
        ELSE 2 * node + 1 END)"""


def _added(trees: str, depth: int) -> str:
    """Sum of what the trees give a row, in their order."""
    return f"aggregate({trees}, 0D, (total, tree) -> total + get(tree.value, {_node('tree', depth)}))"


# --- growing ---------------------------------------------------------------------------------


def chosen_columns(n: int, share: float, tree: int, seed: int) -> list[int]:
    """The features a tree may split on, by hash."""
    order = sorted(range(n), key=lambda f: hashlib.md5(f"{seed}:columns{tree}:{f}".encode()).hexdigest())
    return sorted(order[: max(1, int(share * n))])


def _per_run(values: list, kind: str) -> str:
    return f"get({_literal(values, f'array<{kind}>')}, run)"


def _histogram(
    state: DataFrame, runs: list[Run], recent: list[list[dict]], growing: list[Tree], tree: int, level: int, ratio: float, seed: int, n: int
) -> DataFrame:
    """Sums of gradients and hessians by run, node of this level, feature and bin."""
    settings = [r.settings for r in runs]
    since = "margin"
    if recent[0]:
        since += " + " + _added(_per_run(recent, f"array<{_TREE}>"), max(s["max_depth"] for s in settings))
    columns = [chosen_columns(n, s["colsample_bytree"], tree, seed) for s in settings]
    return (
        state.withColumn("drawn", draw(seed, f"rows{tree}", F.col("_key")))
        .selectExpr("_y", "_fold", "_bins", "drawn", "posexplode(margins) AS (run, margin)")
        .where(f"_fold != {_per_run([r.held_out for r in runs], 'int')}")
        .where(f"drawn < {_per_run([s['subsample'] for s in settings], 'double')}")
        .selectExpr(
            "run",
            "_bins",
            "_y",
            f"CASE WHEN _y = 1 THEN {ratio!r}D ELSE 1D END AS weight",
            f"1D / (1D + exp(-({since}))) AS p",
            f"{_per_run([t.literal() for t in growing], _TREE)} AS tree",
        )
        .selectExpr(
            "run",
            "_bins",
            f"{_node('tree', level)} AS node",
            f"floor(weight * (p - _y) * {PARTS!r}D + 0.5D) AS g",
            f"floor(weight * p * (1D - p) * {PARTS!r}D + 0.5D) AS h",
        )
        .where(f"node >= {1 << level}")
        .selectExpr("run", "node", "g", "h", "posexplode(_bins) AS (feature, bin)")
        .where(f"array_contains({_per_run(columns, 'array<int>')}, feature)")
        .groupBy("run", "node", "feature", "bin")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )


def _best_splits(histogram: DataFrame, runs: list[Run], n: int) -> DataFrame:
    """Per (run, node): its sums, and its best split if one gains enough; ties go to the
    first feature, the lowest bin and missing values on the right."""
    own = "(PARTITION BY run, node, feature)"
    upto = "(PARTITION BY run, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    ridge = _per_run([float(r.settings["reg_lambda"]) for r in runs], "double")
    gamma = _per_run([float(r.settings["gamma"]) for r in runs], "double")

    def worth(g: str, h: str) -> str:
        slope = f"(CAST({g} AS DOUBLE) / {PARTS!r}D)"
        return f"({slope} * {slope} / (CAST({h} AS DOUBLE) / {PARTS!r}D + {ridge}))"

    sums = [
        text
        for c in ("g", "h")
        for text in (
            f"sum({c}) OVER {own} AS {c}a",
            f"coalesce(sum(CASE WHEN bin < 0 THEN {c} END) OVER {own}, 0) AS {c}n",
            f"CASE WHEN feature = {n - 1} THEN {c}"
            f" ELSE coalesce(sum(CASE WHEN bin >= 0 THEN {c} END) OVER {upto}, 0) END AS {c}l",
        )
    ]
    sides = "inline(array(struct(false AS to_left, gl, hl), struct(true AS to_left, gl + gn AS gl, hl + hn AS hl)))"
    least = int(LEAST_HESSIAN * PARTS)
    enough = f"hl >= {least} AND ha - hl >= {least} AND gain > {LEAST_GAIN!r}D"
    order = "struct(gain, -feature AS feature, -bin AS bin, NOT to_left AS to_right, gl, hl)"
    return (
        histogram.selectExpr("run", "node", "feature", "bin", *sums)
        .selectExpr("run", "node", "feature", "bin", "ga", "ha", sides)
        .where(f"feature < {n - 1} OR NOT to_left")
        .selectExpr(
            "*",
            f"0.5D * ({worth('gl', 'hl')} + {worth('ga - gl', 'ha - hl')} - {worth('ga', 'ha')}) - {gamma} AS gain",
        )
        .groupBy("run", "node")
        .agg(
            F.max("ga").alias("g"),
            F.max("ha").alias("h"),
            F.expr(f"max(CASE WHEN {enough} THEN {order} END)").alias("best"),
        )
    )


def _value(g: int, h: int, settings: dict) -> float:
    below = h / PARTS + settings["reg_lambda"]
    return -(g / PARTS) / below * settings["learning_rate"] if below else 0.0


def _grow(found: list, growing: list[Tree], runs: list[Run], level: int) -> bool:
    """Put the splits of a level into the trees; whether any node was split."""
    split = False
    for row in found:
        tree, settings = growing[row["run"]], runs[row["run"]].settings
        node, g, h, best = row["node"], row["g"], row["h"], row["best"]
        tree.value[node] = _value(g, h, settings)
        if best is None or level >= settings["max_depth"]:
            continue
        split = True
        tree.feature[node], tree.bin[node] = -best["feature"], -best["bin"]
        tree.left[node], tree.gain[node] = not best["to_right"], best["gain"]
        tree.value[2 * node] = _value(best["gl"], best["hl"], settings)
        tree.value[2 * node + 1] = _value(g - best["gl"], h - best["hl"], settings)
    return split


def prepared(df: DataFrame, key: str, label: str, features: list[str], category: str, cuts, fold: str | None) -> DataFrame:
    """What growing reads of a row: key, label, fold and bins."""
    return df.select(
        F.col(key).alias("_key"),
        F.col(label).cast("int").alias("_y"),
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"),
        binned(features, category, cuts).alias("_bins"),
    )


def boost(
    df: DataFrame,
    runs: list[Run],
    features: list[str],
    category: str,
    label: str,
    ratio: float,
    key: str = "driver_id",
    fold: str | None = None,
    seed: int = 42,
    on_margins: Callable[[DataFrame, list[int], int], None] | None = None,
    stops: Sequence[int] = (),
) -> list[Ensemble]:
    """Grow all runs side by side; pass a stored table.

    ``ratio`` weighs the rows of label 1. ``on_margins(table, numbers, trees)`` is called when
    as many trees stand as one of ``stops`` says, with the margins of the runs of these numbers,
    in this order, as ``margins`` beside ``_y`` and ``_fold``.
    """
    cuts = cut_points(df, features)
    n = len(features) + 1
    done = [Ensemble(list(features), category, cuts, dict(r.settings)) for r in runs]
    rows = prepared(df.where(F.col(label).isNotNull()), key, label, features, category, cuts, fold)
    live = list(range(len(runs)))
    with _Margins(rows.withColumn("margins", F.array_repeat(F.lit(0.0), len(runs)))) as state:
        recent: list[list[dict]] = [[] for _ in live]
        for tree in range(max(r.settings["n_estimators"] for r in runs)):
            now = [runs[i] for i in live]
            depth = max(r.settings["max_depth"] for r in now)
            growing = [Tree.empty(depth) for _ in live]
            for level in range(depth):
                cells = _histogram(state.table, now, recent, growing, tree, level, ratio, seed, n)
                if not _grow(_best_splits(cells, now, n).collect(), growing, now, level):
                    break
            for own, i, grown in zip(recent, live, growing, strict=True):
                done[i].trees.append(grown)
                own.append(grown.literal())
            over = [i for i in live if runs[i].settings["n_estimators"] == tree + 1]
            if len(over) == len(live) and not stops:
                break
            if over or tree + 1 in stops or (tree + 1) % TREES_APART == 0:
                state.add(recent, depth)
                recent = [[] for _ in live]
            if on_margins and tree + 1 in stops:
                on_margins(state.table, list(live), tree + 1)
            if over:
                kept = [at for at, i in enumerate(live) if i not in over]
                live = [live[at] for at in kept]
                if not live:
                    break
                recent = [[] for _ in live]
                state.keep(kept)
    return done


class _Margins:
    """The table of margins, rewritten as trees are added; each copy goes with the next."""

    def __init__(self, df: DataFrame) -> None:
        self.first, self.copy = df, None

    def __enter__(self) -> _Margins:
        self._put(self.first)
        return self

    def __exit__(self, *error) -> None:
        self.copy.__exit__(*error)

    def _put(self, df: DataFrame) -> None:
        old, self.copy = self.copy, staged(df, "margins")
        self.table = self.copy.__enter__()
        if old is not None:
            old.__exit__(None, None, None)

    def add(self, recent: list[list[dict]], depth: int) -> None:
        trees = _literal(recent, f"array<array<{_TREE}>>")
        margins = F.expr(f"zip_with(margins, {trees}, (margin, own) -> margin + {_added('own', depth)})")
        self._put(self.table.withColumn("margins", margins))

    def keep(self, kept: list[int]) -> None:
        self.table = self.table.withColumn("margins", F.array(*[F.col("margins")[at] for at in kept]))
