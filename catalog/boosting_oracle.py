"""The boosted ensemble in SQL: the same trees, grown level by level by common table expressions.

Written from the definition of the trees, with joins and windows of its own: a row keeps the
node it has got to, and splits are joined to it.
"""

from __future__ import annotations

from catalog.campaign_queries import uniform_sql
from fleetcohort.plans.boosting import BINS, LEAST_GAIN, LEAST_HESSIAN, chosen_columns
from fleetcohort.settings import CHURN_NUMERIC_FEATURES, SEED

_PARTS = "16777216::DOUBLE"
_N = len(CHURN_NUMERIC_FEATURES)


def _grain(column: str) -> str:
    return f"round_even({column}::DOUBLE * 1000000::DOUBLE, 0)"


def _place(column: str, i: int) -> str:
    """Bin of a numeric feature: the cut points below it."""
    return (
        f"CASE WHEN {column} IS NULL THEN -1 ELSE"
        f" len(list_filter(cuts[{i + 1}], lambda c: c < {_grain(column)}))::INT END"
    )


def bins_sql(table: str, tag: str) -> str:
    """``table`` with ``b``, the bins of its features under the cut points of this ensemble."""
    numbers = ", ".join(_place(c, i) for i, c in enumerate(CHURN_NUMERIC_FEATURES))
    return f"SELECT t.*, [{numbers}, coalesce(cluster_label, -1)] AS b FROM {table} t, {tag}_cuts"


def _gain(g: str, h: str, ridge: float) -> str:
    return f"((({g})::DOUBLE / {_PARTS}) * (({g})::DOUBLE / {_PARTS}) / (({h})::DOUBLE / {_PARTS} + {ridge}::DOUBLE))"


def _left(split: str) -> str:
    own = f"b[{split}.f + 1]"
    return f"CASE WHEN {split}.f = {_N} THEN {own} = {split}.bin WHEN {own} < 0 THEN {split}.to_left ELSE {own} <= {split}.bin END"


def ensemble(table: str, learns: str, settings: dict, tag: str, seed: int = SEED) -> dict[str, str]:
    """Expressions that grow the ensemble on the rows of ``table`` for which ``learns`` holds.

    ``<tag>_cuts``, a table of splits and one of values for each tree, ``<tag>_splits`` (all
    splits) and ``<tag>_m<trees>`` (the margin of every row, learnt from or not).
    """
    steps = ", ".join(repr(i / BINS) for i in range(1, BINS))
    cuts = ", ".join(
        f"quantile_cont({_grain(c)}, [{steps}]) FILTER (WHERE {learns})" for c in CHURN_NUMERIC_FEATURES
    )
    depth, ridge = settings["max_depth"], settings["reg_lambda"]
    parts = {
        f"{tag}_cuts": f"SELECT [{cuts}] AS cuts FROM {table}",
        f"{tag}_m0": f"""SELECT driver_id, "Churned" AS y, {learns} AS learns, b, 0.0::DOUBLE AS margin
                         FROM ({bins_sql(table, tag)})""",
        f"{tag}_weight": f"""SELECT count(*) FILTER (y = 0)::DOUBLE / count(*) FILTER (y = 1) AS ratio
                             FROM {tag}_m0 WHERE learns""",
    }
    least = int(LEAST_HESSIAN * 2**24)
    for t in range(settings["n_estimators"]):
        name = f"{tag}_{t}"
        parts[f"{name}_at0"] = f"""
          SELECT driver_id, y, learns, b, margin, 1 AS node,
                 learns AND {uniform_sql(f"rows{t}", "driver_id", seed=seed)} < {settings["subsample"]!r}::DOUBLE AS drawn,
                 floor(w * (p - y) * {_PARTS} + 0.5)::BIGINT AS g,
                 floor(w * p * (1 - p) * {_PARTS} + 0.5)::BIGINT AS h
          FROM (SELECT *, CASE WHEN y = 1 THEN (SELECT ratio FROM {tag}_weight) ELSE 1.0::DOUBLE END AS w,
                       1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) AS p FROM {tag}_m{t})"""
        columns = chosen_columns(_N + 1, settings["colsample_bytree"], t, seed)
        for d in range(depth):
            parts[f"{name}_best{d}"] = f"""
              SELECT node, f, bin, to_left, gain FROM (
                SELECT *, 0.5::DOUBLE * ({_gain("gl", "hl", ridge)} + {_gain("ga - gl", "ha - hl", ridge)}
                                         - {_gain("ga", "ha", ridge)}) - {settings["gamma"]}::DOUBLE AS gain
                FROM (
                  SELECT node, f, bin, to_left, ga, ha,
                         CASE WHEN f = {_N} THEN g WHEN to_left THEN gp + gn ELSE gp END AS gl,
                         CASE WHEN f = {_N} THEN h WHEN to_left THEN hp + hn ELSE hp END AS hl
                  FROM (
                    SELECT *, sum(g) OVER every AS ga, sum(h) OVER every AS ha,
                           coalesce(sum(g) FILTER (WHERE bin < 0) OVER every, 0) AS gn,
                           coalesce(sum(h) FILTER (WHERE bin < 0) OVER every, 0) AS hn,
                           coalesce(sum(g) FILTER (WHERE bin >= 0) OVER upto, 0) AS gp,
                           coalesce(sum(h) FILTER (WHERE bin >= 0) OVER upto, 0) AS hp
                    FROM (SELECT node, f, b[f + 1] AS bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h
                          FROM {name}_at{d}, (SELECT unnest({columns}) AS f)
                          WHERE drawn AND node >= {1 << d} GROUP BY ALL)
                    WINDOW every AS (PARTITION BY node, f),
                           upto AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
                  (VALUES (false), (true)) v(to_left)
                  WHERE f < {_N} OR NOT to_left)
                WHERE hl >= {least} AND ha - hl >= {least})
              WHERE gain > {LEAST_GAIN!r}::DOUBLE
              QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin, to_left) = 1"""
            parts[f"{name}_at{d + 1}"] = f"""
              SELECT a.* REPLACE (CASE WHEN s.node IS NULL THEN a.node WHEN {_left("s")} THEN 2 * a.node
                                       ELSE 2 * a.node + 1 END AS node)
              FROM {name}_at{d} a LEFT JOIN {name}_best{d} s ON a.node = s.node"""
        parts[f"{name}_splits"] = " UNION ALL ".join(f"SELECT * FROM {name}_best{d}" for d in range(depth))
        parts[f"{name}_value"] = f"""
          SELECT node, -(sum(g)::DOUBLE / {_PARTS}) / (sum(h)::DOUBLE / {_PARTS} + {ridge}::DOUBLE)
                       * {settings["learning_rate"]!r}::DOUBLE AS value
          FROM {name}_at{depth} WHERE drawn GROUP BY node"""
        parts[f"{tag}_m{t + 1}"] = f"""
          SELECT driver_id, y, learns, b, margin + coalesce(value, 0.0::DOUBLE) AS margin
          FROM {name}_at{depth} LEFT JOIN {name}_value USING (node)"""
    parts[f"{tag}_splits"] = " UNION ALL ".join(
        f"SELECT {t} AS tree, * FROM {tag}_{t}_splits" for t in range(settings["n_estimators"])
    )
    return parts


def margins(table: str, settings: dict, tag: str) -> str:
    """Margin of each row of a table that has ``driver_id`` and ``b``, by walking the stored
    splits: one join a level and tree."""
    walks = []
    for t in range(settings["n_estimators"]):
        at = f"SELECT driver_id, b, 1 AS node FROM {table}"
        for d in range(settings["max_depth"]):
            at = f"""SELECT a.driver_id, a.b, CASE WHEN s.node IS NULL THEN a.node WHEN {_left("s")}
                       THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
                     FROM ({at}) a LEFT JOIN {tag}_{t}_best{d} s ON a.node = s.node"""
        walks.append(f"SELECT {t} AS tree, driver_id, value FROM ({at}) LEFT JOIN {tag}_{t}_value USING (node)")
    return f"""SELECT driver_id, list_sum(list(coalesce(value, 0.0::DOUBLE) ORDER BY tree)) AS margin
               FROM ({" UNION ALL ".join(walks)}) GROUP BY driver_id"""
