"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on statistics of labelled texts; every path from a root to a node is a rule, a
conjunction of threshold tests. A lasso logistic regression weighs the rules, most weights
become zero, and the others compile into one Spark column expression, so scoring is a
projection without Python.

Only statistics of the text are inputs: no label, language, source or key. Rows without a
label (null counts as none) teach nothing; if a key has several labels its greatest counts.
With fewer than two classes among the training rows there are no rules and the score is the
share of label 1, or 0.5 without labels. Null and empty texts have all statistics zero and get
a score like any other. Null keys are never training rows. Repeated rows are scored one by
one. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.llm.common import crc_mod, keyed_text, stage

#: Labelled rows that a fit takes at most; beyond, a sample by key hash of about this size.
MAX_TRAINING_ROWS = 50_000
TREES, DEPTH, LASSO, SEED = 16, 3, 1e-3, 7

STATISTICS = [
    "log_chars", "word_chars", "upper", "digits", "symbols", "bars", "calls", "stops",
    "distinct_words", "repeats", "distinct_lines", "line_chars",
]


def with_statistics(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds the statistics of the text column, as columns named ``prefix`` + statistic.

    They leave a generator of one row, so the optimiser cannot put their expressions in the
    place of each use: every statistic is computed once per row, however many rules read it.
    """

    def share(pattern: str) -> Column:
        rest = F.length(F.regexp_replace(F.col(text), pattern, ""))
        return (chars - rest) / F.greatest(chars, ones)

    words, lines = f"{prefix}words", f"{prefix}lines"
    ones = F.lit(1)
    chars = F.length(text).cast("double")
    df = df.withColumns(
        {
            words: F.filter(F.split(text, "[ \t\r\n\f]+"), lambda w: w != ""),
            lines: F.filter(F.split(text, "\n"), lambda x: x != ""),
        }
    )
    n_words, n_lines = F.greatest(F.size(words), ones), F.greatest(F.size(lines), ones)
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    found = {
        "log_chars": F.log1p(chars),
        "word_chars": chars / n_words,
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"\p{Nd}+"),
        "symbols": share(r"[#$%&*+<=>@^_`~\\{}\[\]]+"),
        "bars": share(r"[|]+"),
        "calls": share(r"[!]+"),
        "stops": share(r"[.,;:?]+"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeats": repeats / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_chars": F.log1p(chars / n_lines),
    }
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (words, lines)]
    row = F.struct(*(found[k].alias(prefix + k) for k in STATISTICS))
    return df.select(*kept, F.inline(F.array(row)))


Test = tuple[int, bool, float]  # statistic, greater (or else at most), threshold


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctive rules over the statistics, and an intercept."""

    intercept: float
    rules: tuple[tuple[float, tuple[Test, ...]], ...]

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1 as a column expression over the statistics columns."""
        total = F.lit(self.intercept)
        for weight, tests in self.rules:
            total = total + F.when(_holds(tests, prefix), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, the heaviest first."""
        return [
            f"{weight:+.3f} if "
            + " and ".join(f"{STATISTICS[s]} {'>' if up else '<='} {at:.4g}" for s, up, at in tests)
            for weight, tests in sorted(self.rules, key=lambda r: -abs(r[0]))
        ]


def _holds(tests: tuple[Test, ...], prefix: str = "") -> Column:
    held = F.lit(True)
    for statistic, greater, at in tests:
        value = F.col(prefix + STATISTICS[statistic])
        held = held & (value > at if greater else value <= at)
    return held


def _paths(node, tests: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    """Every path from the root to a node below it, repeated tests of a statistic narrowed."""
    found = [tests] if tests else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        statistic, at = int(split.featureIndex()), float(split.threshold())
        for greater, child in ((False, node.leftChild()), (True, node.rightChild())):
            old = [t for t in tests if t[:2] == (statistic, greater)]
            rest = tuple(t for t in tests if t[:2] != (statistic, greater))
            tight = (max if greater else min)([at, *(t[2] for t in old)])
            found += _paths(child, tuple(sorted((*rest, (statistic, greater, tight)))))
    return found


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    held_out_of: int | None = 5,
    max_rows: int = MAX_TRAINING_ROWS,
) -> RuleModel:
    """Learn from the labelled rows whose crc32(key) modulo ``held_out_of`` is not 0 (all, if
    it is None), at most about ``max_rows`` of them, chosen by a hash of the key."""
    rows = keyed_text(docs, key, text).where(F.col("key").isNotNull())
    marks = labels.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label")
    ).dropna()
    if held_out_of is not None:
        marks = marks.where(crc_mod("key", held_out_of) != 0)
        rows = rows.where(crc_mod("key", held_out_of) != 0)
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    n = marks.count()
    if n > max_rows:
        kept = F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 20)) < max_rows * (1 << 20) // n
        marks, rows = marks.where(kept), rows.where(kept)
    # Statistics before the join: a few numbers move, not the texts.
    measured = with_statistics(rows, "text", "").drop("text")
    train = stage(measured.join(marks, "key").select("label", *STATISTICS), "quality-rows")
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    good, total = classes.get(1.0, 0), sum(classes.values())
    if good in (0, total):
        share = min(max(good / total, 1e-6), 1 - 1e-6) if total else 0.5
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="vector").transform(train)
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
        featureSubsetStrategy="onethird", bootstrap=False, minInstancesPerNode=5, seed=SEED,
    ).fit(vectors)
    rules = sorted({p for t in forest.trees for p in _paths(t._call_java("rootNode"))})
    if not rules:
        return RuleModel(math.log(good / (total - good)), ())
    held = train.select(
        "label",
        array_to_vector(F.array(*(_holds(r).cast("double") for r in rules))).alias("held"),
    )
    lasso = LogisticRegression(
        featuresCol="held", labelCol="label", elasticNetParam=1.0, regParam=LASSO,
        standardization=False, maxIter=60,
    ).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    chosen = tuple((w, r) for w, r in zip(weights, rules, strict=True) if w)
    return RuleModel(float(lasso.intercept), chosen)


def score(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and ``score``."""
    rows = with_statistics(keyed_text(docs, key, text), "text", "")
    return rows.select(F.col("key").alias(key), model.score().alias("score"))


def keep_good(
    docs: DataFrame, model: RuleModel, least: float = 0.3, text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all their columns unchanged."""
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    whole = docs.withColumn(f"{prefix}text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    measured = with_statistics(whole, f"{prefix}text", prefix)
    return measured.where(model.score(prefix) >= least).select(*(f"`{c}`" for c in docs.columns))
