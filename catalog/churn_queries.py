"""Churn model queries: evaluation, and ensembles that the checking SQL grows as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import boosting_oracle
from catalog.campaign_queries import chain, uniform_sql
from catalog.oracle_base import rounded, sql
from catalog.scored import DISTANCES, SCORED_SQL, UNROUNDED_SQL, Z, anchors, labelled, scored_drivers, unrounded
from catalog.tables import stored_features, written_once
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.operators.nearest import assign_nearest
from fleetcohort.plans import churn, evaluation, scoring, segments
from fleetcohort.settings import CHURN_FEATURES

_fits: dict[tuple, tuple] = {}


def _once(s, d, label, fit):
    """A fit of this session and folder, shared by the queries that need it."""
    key = (s.sparkContext.applicationId, d, label)
    if key not in _fits:
        _fits[key] = fit()
    return _fits[key]


def _predicted(s, d):
    return scored_drivers(s, d).withColumn("predicted", F.col("is_high_risk").cast("int"))


#: Few trees, so that SQL can grow them too.
CHECKED = {**churn.DEFAULT_PARAMS, "n_estimators": 8, "max_depth": 3, "learning_rate": 0.3}


def _labelled(s, d):
    """Feature table with clusters and personas by fixed anchors, which SQL can reproduce, and
    the side of the split."""

    def build(spark, folder):
        table = labelled(spark, folder)
        personas = segments.persona_rules(segments.centroid_means(table))
        # One row per cluster.
        return churn.with_split(table.join(F.broadcast(personas), "cluster_label"))

    return written_once(s, d, "labelled", build)


def _fit(s, d):
    rows = _labelled(s, d)
    return rows, _once(s, d, "train", lambda: churn.fit_churn(rows.filter(~F.col("is_test")), CHECKED))


def _sides(counts):
    """The report and the AUC of both sides of the split."""
    parts = [
        evaluation.classification_report(part, churn.TARGET, "churn_prediction", weight="n")
        .withColumn("split", F.lit(name))
        .withColumn(
            "auc", evaluation.roc_auc(part, churn.TARGET, churn.RAW, weight="n").select("auc").scalar()
        )
        for name, part in (
            ("train", counts.filter(~F.col("is_test"))),
            ("test", counts.filter("is_test")),
        )
    ]
    return parts[0].unionByName(parts[1])


def _metrics(s, d):
    """The report and the AUC of both sides, from one pass of the ensemble."""
    rows, model = _fit(s, d)
    both = _sides(written_once(s, d, "score-counts", lambda *_: churn.score_counts(rows, model)))
    return both.withColumns(
        {c: round_half_even(F.col(c), 9) for c in ("precision", "recall", "f1", "auc")}
    )


def _whole(s, d):
    """The ensemble fitted on all drivers."""
    return _once(s, d, "whole", lambda: churn.fit_churn(_labelled(s, d), CHECKED))


def _scores(s, d):
    scored = churn.flag_high_risk(churn.predict(_labelled(s, d), _whole(s, d)))
    return scored.select("driver_id", "cluster_label", "persona", "churn_probability", "is_high_risk")


RAISED = "avg_earnings_per_hour_online"


def _what_if(s, d):
    """Every driver re-scored as if it earned a fifth more per online hour: the cluster is
    assigned anew, on the scale of the earnings as they are."""
    rows = _labelled(s, d)
    stats = rows.agg(F.avg(segments.filled(RAISED)).alias("m"), F.stddev_pop(segments.filled(RAISED)).alias("s")).first()
    raised = rows.drop("cluster_label", "persona").withColumn(RAISED, F.col(RAISED) * 1.2)
    raised = raised.withColumn(f"z_{RAISED}", (segments.filled(RAISED) - stats["m"]) / stats["s"])
    moved = assign_nearest(raised, anchors(s), "cluster_label", Z)
    now, then = churn.predict(rows, _whole(s, d)), churn.predict(moved, _whole(s, d))
    return now.select("driver_id", F.col("churn_probability").alias("now")).join(
        then.select("driver_id", F.col("churn_probability").alias("raised")), "driver_id"
    )


def _importance(s, d):
    _, model = _fit(s, d)
    table = churn.feature_importance(s, model)
    return table.withColumn("importance", round_half_even(F.col("importance"), 9))


def _checks(df, **bad):
    """One row per name: how many rows of ``df`` meet the condition."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    rows = [
        F.struct(F.lit(n.replace("_", " ")).alias("check"), F.col(n).cast("double").alias("value"))
        for n in bad
    ]
    return counts.select(F.inline(F.array(*rows)))


def _fitted(s, d):
    """Segments and default ensemble of a short production run, all of it fitted."""

    def fit():
        features = stored_features(s, d)
        model = segments.fit_segments(features)
        clustered = written_once(s, d, "clustered-all", lambda *_: model.transform(features))
        return model, churn.fit_churn(clustered, CHECKED)

    return _once(s, d, "fitted", fit)


def _fitted_train(s, d):
    """Clusters and side of the split of every driver, and the ensemble of the training side; the
    segments see training rows only."""

    def build(spark, folder):
        features = churn.with_split(stored_features(spark, folder))
        return segments.fit_segments(features.filter(~F.col("is_test"))).transform(features)

    rows = written_once(s, d, "clustered-train", build)
    return rows, _once(
        s, d, "fitted-train", lambda: churn.fit_churn(rows.filter(~F.col("is_test")), CHECKED)
    )


def _invariants(s, d):
    """What must hold of every fit, whatever it learned."""
    features = stored_features(s, d)
    segment_model, model = _fitted(s, d)
    scores = written_once(
        s, d, "fitted-scores", lambda *_: scoring.score_drivers(features, segment_model, model)
    )
    centres = segments.centroids_in_units(segment_model.scale, segment_model.centres)
    rules = segments.persona_rules(centres).select("cluster_label", F.col("persona").alias("rule"))
    named = scores.join(rules, "cluster_label", "left")
    share = F.col("churn_probability")
    parts = [
        _checks(
            named,
            drivers_scored=F.lit(True),
            probability_outside_its_range=~share.between(0, 1),
            flag_differs_from_the_probability=F.col("is_high_risk") != (share >= 0.5),
            persona_differs_from_the_rule=~F.col("persona").eqNullSafe(F.col("rule")),
        )
    ]
    # Every centre, without the array functions that chose the label.
    far = [
        sum(
            (F.pow(F.col("_at")[i] - F.lit(x), 2) for i, x in enumerate(centre)),
            F.lit(0.0),
        )
        for centre in segment_model.centres
    ]
    distances = scores.withColumn("_at", segment_model.scale.vector()).withColumn("_far", F.array(*far))
    own = F.get("_far", F.col("cluster_label"))
    parts.append(_checks(distances, label_is_not_the_nearest=own > F.array_min("_far")))
    rows, trained = _fitted_train(s, d)
    counts = written_once(s, d, "fitted-counts", lambda *_: churn.score_counts(rows, trained))
    report = written_once(s, d, "fitted-report", lambda *_: _sides(counts))
    parts.append(
        _checks(
            report,
            report_lines=F.lit(True),
            auc_outside_its_range=~F.col("auc").between(0, 1),
            rate_outside_its_range=~(
                F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
            ),
        )
    )
    total = report.where("row = 'accuracy'").groupBy(
        F.concat(F.lit("rows of the "), "split", F.lit(" side")).alias("check")
    )
    parts.append(total.agg(F.sum("support").cast("double").alias("value")))
    importance = churn.feature_importance(s, trained).agg(
        F.lit("importances sum to").alias("check"),
        round_half_even(F.sum("importance"), 9).alias("value"),
    )
    for part in parts:
        importance = importance.unionByName(part)
    return importance


def _report(s, d):
    table = evaluation.classification_report(_predicted(s, d), churn.TARGET, "predicted")
    return table.withColumns(
        {c: round_half_even(F.col(c), 9) for c in ("precision", "recall", "f1")}
    )


QUERIES = {
    "train_test_split_hash": lambda s, d: churn.with_split(stored_features(s, d)).select(
        "driver_id", "is_test"
    ),
    "stratified_folds": lambda s, d: churn.with_folds(stored_features(s, d), 5).select(
        "driver_id", "Churned", "fold"
    ),
    "class_weight": lambda s, d: evaluation.class_balance(stored_features(s, d), churn.TARGET),
    "roc_auc_exact": lambda s, d: evaluation.roc_auc(
        unrounded(s, d), churn.TARGET, "score"
    ).withColumn("auc", round_half_even(F.col("auc"), 9)),
    "confusion_matrix": lambda s, d: evaluation.confusion_matrix(
        _predicted(s, d), churn.TARGET, "predicted"
    ),
    "classification_report": _report,
    "churn_model_metrics": _metrics,
    "churn_feature_importance": _importance,
    "churn_scores": _scores,
    "what_if_scores": _what_if,
    "fitted_invariants": _invariants,
}

_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-margin))"
_COUNTS = ", ".join(
    f"(count(*) FILTER (y = {a} AND guess = {g}))::DOUBLE AS {name}"
    for name, a, g in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
)


def _grown(body: str, tag: str, **extra: str) -> str:
    """``body`` over the ensemble of all drivers (whole) or of the training side (train)."""
    learns = "true" if tag == "whole" else f"NOT ({uniform_sql('split', 'driver_id')} < 0.2)"
    grown = boosting_oracle.ensemble("labelled", learns, CHECKED, tag)
    return sql(body, "features", extra={**SCORED_SQL, **grown, **extra}, once=True)


_CELL = """(count(*) FILTER ("Churned" = {a} AND is_high_risk = {p}))::DOUBLE"""
_TN, _FP = _CELL.format(a=0, p="false"), _CELL.format(a=0, p="true")
_FN, _TP = _CELL.format(a=1, p="false"), _CELL.format(a=1, p="true")

ORACLE = {
    "train_test_split_hash": chain(
        f"SELECT driver_id, {uniform_sql('split', 'driver_id')} < 0.2 AS is_test FROM features"
    ),
    "stratified_folds": chain(
        f"""SELECT driver_id, "Churned",
                   CAST((row_number() OVER (PARTITION BY "Churned"
                         ORDER BY {uniform_sql("fold", "driver_id")}, driver_id) - 1) % 5 AS INT)
                     AS fold FROM features"""
    ),
    "fitted_invariants": chain(
        f"""SELECT v."check", v.value::DOUBLE AS value FROM (VALUES
              ('probability outside its range', 0), ('flag differs from the probability', 0),
              ('persona differs from the rule', 0), ('label is not the nearest', 0),
              ('report lines', 10), ('auc outside its range', 0), ('rate outside its range', 0),
              ('importances sum to', 1)) v("check", value)
            UNION ALL SELECT 'drivers scored', count(*)::DOUBLE FROM features
            UNION ALL SELECT 'rows of the test side', count(*)::DOUBLE FROM features
                      WHERE {uniform_sql("split", "driver_id")} < 0.2
            UNION ALL SELECT 'rows of the train side', count(*)::DOUBLE FROM features
                      WHERE {uniform_sql("split", "driver_id")} >= 0.2"""
    ),
    "churn_scores": _grown(
        f"""SELECT driver_id, cluster_label, persona, p AS churn_probability, p >= 0.5 AS is_high_risk
            FROM (SELECT driver_id, {rounded(_P, 4)} AS p FROM whole_m{CHECKED["n_estimators"]})
            JOIN labelled USING (driver_id) JOIN personas USING (cluster_label)""",
        "whole",
    ),
    "what_if_scores": _grown(
        f"""SELECT driver_id, n.p AS now, r.p AS raised
            FROM (SELECT driver_id, {rounded(_P, 4)} AS p FROM whole_m{CHECKED["n_estimators"]}) n
            JOIN (SELECT driver_id, {rounded(_P, 4)} AS p
                  FROM ({boosting_oracle.margins("raised_bins", CHECKED, "whole")})) r USING (driver_id)""",
        "whole",
        raised=f"""SELECT * EXCLUDE (ds), CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS cluster_label
                   FROM (SELECT *, [{", ".join(DISTANCES[i] for i in range(len(DISTANCES)))}] AS ds
                         FROM (SELECT * REPLACE ({RAISED} * 1.2::DOUBLE AS {RAISED},
                                                 (coalesce({RAISED} * 1.2::DOUBLE, 0) - m) / s AS z_{RAISED})
                               FROM standard, (SELECT avg(coalesce({RAISED}, 0)) AS m,
                                                      stddev_pop(coalesce({RAISED}, 0)) AS s FROM features)))""",
        raised_bins=boosting_oracle.bins_sql("raised", "whole"),
    ),
    "churn_feature_importance": _grown(
        f"""SELECT feature, {rounded("coalesce(gain, 0) / sum(gain) OVER ()", 9)} AS importance
            FROM (SELECT f, avg(gain) AS gain FROM train_splits GROUP BY f)
            RIGHT JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CHURN_FEATURES))}) v(f, feature)
            USING (f)""",
        "train",
    ),
    "churn_model_metrics": _grown(
        f"""SELECT * FROM (WITH c AS (SELECT split, {_COUNTS} FROM predicted GROUP BY split),
            r AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
                         coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
                         tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS s FROM c),
            f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
                         coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM r),
            a AS (SELECT split, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
                         / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc
                  FROM (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p)
                               + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0::DOUBLE AS r FROM predicted)
                  GROUP BY split)
            SELECT split, row, {rounded("precision", 9)} AS precision, {rounded("recall", 9)} AS recall,
                   {rounded("f1", 9)} AS f1, support::BIGINT AS support, {rounded("auc", 9)} AS auc
            FROM (SELECT split, '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
                  UNION ALL SELECT split, '1', p1, r1, f1, s1 FROM f
                  UNION ALL SELECT split, 'accuracy', (tn + tp) / s, (tn + tp) / s, (tn + tp) / s, s FROM f
                  UNION ALL SELECT split, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM f
                  UNION ALL SELECT split, 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s,
                                   (f0 * s0 + f1 * s1) / s, s FROM f)
            JOIN a USING (split))""",
        "train",
        predicted=f"""SELECT CASE WHEN learns THEN 'train' ELSE 'test' END AS split, y, {_P} AS p,
                             ({_P} > 0.5)::INT AS guess FROM train_m{CHECKED["n_estimators"]}""",
    ),
    "class_weight": chain(
        """SELECT n::BIGINT AS negatives, p::BIGINT AS positives, n::DOUBLE / nullif(p, 0) AS ratio
           FROM (SELECT count(*) FILTER ("Churned" = 0) AS n, count(*) FILTER ("Churned" = 1) AS p
                 FROM features)"""
    ),
    "roc_auc_exact": chain(
        f"""SELECT p::BIGINT AS positives, n::BIGINT AS negatives,
                   {rounded("(ranks - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n)", 9)} AS auc
            FROM (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n,
                         sum(r) FILTER (y = 1) AS ranks
                  FROM (SELECT "Churned" AS y,
                               rank() OVER (ORDER BY score)
                               + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE
                                 AS r FROM ({UNROUNDED_SQL})))"""
    ),
    "confusion_matrix": chain(
        """SELECT a::INT AS actual, p::INT AS predicted,
                  (SELECT count(*) FROM scored
                   WHERE "Churned" = a AND is_high_risk = (p = 1))::BIGINT AS n
           FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p)"""
    ),
    "classification_report": chain(
        f"""SELECT row, {rounded("precision", 9)} AS precision, {rounded("recall", 9)} AS recall,
                   {rounded("f1", 9)} AS f1, support::BIGINT AS support
            FROM (
              WITH c AS (SELECT {_TN} AS tn, {_FP} AS fp, {_FN} AS fn, {_TP} AS tp FROM scored),
              r AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0,
                           tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
                           tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS s FROM c),
              f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM r)
              SELECT '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
              UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
              UNION ALL SELECT 'accuracy', (tn + tp) / s, (tn + tp) / s, (tn + tp) / s, s FROM f
              UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM f
              UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s,
                               (f0 * s0 + f1 * s1) / s, s FROM f)"""
    ),
}
