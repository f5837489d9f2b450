"""k-means in SQL: exact sums, D² starts by hash, and rounds of assignment and means."""

from __future__ import annotations

from fleetcohort.plans.kmeans import ROUNDS
from fleetcohort.settings import CLUSTERING_FEATURES, SEED

_DIMS = range(len(CLUSTERING_FEATURES))
_D = " + ".join(f"(v.x{i} - t.x{i}) * (v.x{i} - t.x{i})" for i in _DIMS)
_X = ", ".join(f"x{i}" for i in _DIMS)


def _grain(column: str) -> str:
    return f"round_even(coalesce({column}, 0)::DOUBLE * 1000000::DOUBLE, 0)"


def fits(ks: list[int], starts: int, seed: int = SEED) -> dict[str, str]:
    """Expressions up to ``km_own`` (row, k, start, cluster, squared distance) and ``km_best``
    (k, start, cost of the best start), over ``features``."""
    sums = ", ".join(
        f"sum({_grain(c)}::HUGEINT)::DOUBLE / count(*) AS m{i},"
        f" sum({_grain(c)}::HUGEINT * {_grain(c)}::HUGEINT)::DOUBLE / count(*) AS q{i}"
        for i, c in enumerate(CLUSTERING_FEATURES)
    )
    spread = ", ".join(f"sqrt(greatest(q{i} - m{i} * m{i}, 0)) AS s{i}" for i in _DIMS)
    vector = ", ".join(
        f"CASE WHEN s{i} = 0 THEN 0 ELSE round_even(({_grain(c)} - m{i}) / s{i} * 1024, 0)::BIGINT END AS x{i}"
        for i, c in enumerate(CLUSTERING_FEATURES)
    )
    parts = {
        "km_scale": f"SELECT *, {spread} FROM (SELECT {sums} FROM features)",
        "km_rows": f"SELECT driver_id, {vector} FROM features, km_scale",
        "km_seed0": _drawn("1::DOUBLE", f"km_rows v, (SELECT unnest(range({starts})) AS start)", 0, seed),
    }
    for at in range(1, max(ks)):
        before = " UNION ALL ".join(f"SELECT * FROM km_seed{i}" for i in range(at))
        weighed = f"""(SELECT v.*, start, min({_D}) AS w FROM km_rows v, ({before}) t
                       GROUP BY ALL HAVING min({_D}) > 0)"""
        parts[f"km_seed{at}"] = _drawn("w", weighed, at, seed)
    seeds = " UNION ALL ".join(f"SELECT {c} AS c, * FROM km_seed{c}" for c in range(max(ks)))
    parts["km_at0"] = f"SELECT k, start, c, {_X} FROM ({seeds}), (SELECT unnest({list(ks)}) AS k) WHERE c < k"
    for r in range(ROUNDS):
        means = ", ".join(
            f"((sum(x{i}) - (sum(x{i}) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x{i}" for i in _DIMS
        )
        kept = ", ".join(f"coalesce(n.x{i}, o.x{i}) AS x{i}" for i in _DIMS)
        parts[f"km_at{r + 1}"] = f"""
          SELECT o.k, o.start, o.c, {kept} FROM km_at{r} o LEFT JOIN (
            SELECT k, start, c, {means} FROM ({_nearest(r)}) JOIN km_rows USING (driver_id) GROUP BY k, start, c) n
          ON o.k = n.k AND o.start = n.start AND o.c = n.c"""
    parts["km_own"] = _nearest(ROUNDS)
    parts["km_best"] = """SELECT k, start, cost / (1024 * 1024)::DOUBLE AS cost
                          FROM (SELECT k, start, sum(d)::DOUBLE AS cost FROM km_own GROUP BY k, start)
                          QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, start) = 1"""
    return parts


def _drawn(weight: str, source: str, at: int, seed: int) -> str:
    word = f"substr(md5('{seed}:start' || start || '-{at}:' || driver_id), 1, 8)"
    key = f"-ln((('0x' || {word})::BIGINT::DOUBLE + 0.5) / 4294967296::DOUBLE) / {weight}"
    return f"""SELECT start, {_X} FROM (SELECT *, {key} AS e FROM {source})
               QUALIFY row_number() OVER (PARTITION BY start ORDER BY e, driver_id) = 1"""


def _nearest(r: int) -> str:
    # Distance and number in one whole number: less than 100 clusters.
    return f"""SELECT driver_id, k, start, z % 100 AS c, z // 100 AS d
               FROM (SELECT driver_id, k, start, min(({_D}) * 100 + c) AS z
                     FROM km_rows v, km_at{r} t GROUP BY driver_id, k, start)"""


def centre_units() -> str:
    """Features of a centre back in their units."""
    return ", ".join(f"(t.x{i} / 1024::DOUBLE * s{i} + m{i}) / 1000000::DOUBLE AS {c}" for i, c in enumerate(CLUSTERING_FEATURES))
