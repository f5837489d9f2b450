"""Data-quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.oracle_base import rounded, sql
from catalog.tables import stored_features
from fleetcohort.functions.numeric import round_half_even
from fleetcohort.plans import profile, quality
from fleetcohort.settings import CORRELATION_FEATURES, EVENT_TYPES, TIERS, TRIP_TYPES
from fleetcohort.sources import fixture
from fleetcohort.sources.raw import numeric_columns

# Distributions are shown for every numeric feature except identifier, label and flag;
# those two are described like any other number.
NOT_PROFILED = ["driver_id", "Churned", "is_premium_capable"]
PROFILED = [
    "avg_rating",
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "premium_trip_ratio",
    "peak_hour_driver_score",
    "session_regularity",
    "quest_completion_rate",
    "incentive_reliance_pct",
    "cancellation_rate",
    "acceptance_rate",
    "session_count",
    "pro_tier_rank",
]
DESCRIBED = [*PROFILED, "is_premium_capable", '"Churned"']
RAW_DESCRIBED = {
    "profiles": ["avg_rating", '"Churned"'],
    "trips": ["trip_duration_seconds", "fare", "tip", "surge_multiplier"],
    "incentives": ["bonus_amount"],
}
STATS = ["mean", "std", "min", "q1", "median", "q3", "max"]
BOXED = ["cancellation_rate", "surge_reliance_score"]
BY_LABEL = ["avg_earnings_per_hour_online", "trip_utilization_rate"]


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), places) for c in columns})


def _describe(s, d):
    features = stored_features(s, d)
    columns = numeric_columns(features, exclude=["driver_id"])
    return _rounded(profile.describe(features, columns), 3, *STATS)


def _describe_raw(s, d):
    """Every number of the raw logs; sessions and interactions hold identifiers only."""
    logs = {"profiles": fixture.profiles, "trips": fixture.trips, "incentives": fixture.incentives}
    parts = []
    for name, read in logs.items():
        columns = [c.strip('"') for c in RAW_DESCRIBED[name]]
        log = read(s, d).select(*[F.col(c).cast("double") for c in columns])
        parts.append(profile.describe(log, columns).withColumn("table", F.lit(name)))
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 3, *STATS)


def _histogram(s, d):
    features = stored_features(s, d)
    columns = numeric_columns(features, exclude=NOT_PROFILED)
    return profile.histogram(features, columns).select("column", "bin", "n")


BOX_COLUMNS = ["q1", "median", "q3", "whisker_low", "whisker_high"]

QUERIES = {
    "null_audit": lambda s, d: quality.null_audit(fixture.raw_logs(s, d)).drop("type"),
    "label_balance": lambda s, d: quality.label_balance(fixture.profiles(s, d)),
    "temporal_violations": lambda s, d: quality.temporal_violations(fixture.raw_logs(s, d)),
    "domain_check": lambda s, d: quality.domain_check(fixture.raw_logs(s, d)),
    "quality_suite": lambda s, d: quality.quality_suite(fixture.raw_logs(s, d)),
    "tier_value_counts": lambda s, d: quality.value_counts(fixture.profiles(s, d), "current_tier"),
    "describe_exact": _describe,
    "describe_raw": _describe_raw,
    "histogram_30": _histogram,
    "box_stats": lambda s, d: _rounded(
        profile.box_stats(stored_features(s, d), BOXED), 6, *BOX_COLUMNS
    ),
    "box_stats_by_label": lambda s, d: _rounded(
        profile.box_stats(stored_features(s, d), BY_LABEL, "Churned"), 3, *BOX_COLUMNS
    ),
    "corr_matrix": lambda s, d: _rounded(
        profile.correlation_matrix(stored_features(s, d)), 6, "r"
    ),
    "kde_grid": lambda s, d: _kde(s, d),
}


def _kde(s, d):
    """Density times bandwidth has no unit, so nine places say as much of every column."""
    features = stored_features(s, d)
    grid = profile.density(features, numeric_columns(features, exclude=NOT_PROFILED))
    return grid.select(
        "column",
        "point",
        round_half_even(F.col("x"), 3).alias("x"),
        round_half_even(F.col("density") * F.col("bandwidth"), 9).alias("density_times_bandwidth"),
        round_half_even(F.col("bandwidth"), 6).alias("bandwidth"),
    )


_AUDITED = {
    "profiles": [
        "driver_id",
        "signup_date",
        "vehicle_dispatchability",
        "avg_rating",
        "current_tier",
        '"Churned"',
    ],
    "sessions": ["session_id", "driver_id", "session_start", "session_end"],
    "trips": [
        "trip_id",
        "driver_id",
        "request_time",
        "trip_duration_seconds",
        "fare",
        "tip",
        "surge_multiplier",
        "trip_type",
    ],
    "incentives": [
        "incentive_id",
        "driver_id",
        "incentive_type",
        "offer_date",
        "status",
        "bonus_amount",
    ],
    "interactions": ["event_id", "driver_id", "event_timestamp", "event_type"],
}


def _null_rows(table: str, column: str) -> str:
    name = column.strip('"')
    return (
        f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", count(*)::BIGINT AS rows, "
        f"(count(*) - count({column}))::BIGINT AS nulls FROM {table}"
    )


_NULLS = " UNION ALL ".join(
    [_null_rows(table, column) for table, columns in _AUDITED.items() for column in columns]
    # pickup_time is request_time plus five minutes.
    + [_null_rows("trips", "request_time").replace("'request_time'", "'pickup_time'")]
)

_ORDER_RULES = """
    SELECT 'session_end after session_start' AS "check",
           (count(*) FILTER (session_end <= session_start))::BIGINT AS bad_rows FROM sessions
    UNION ALL
    SELECT 'pickup_time after request_time',
           (count(*) FILTER (request_time + INTERVAL 5 MINUTE <= request_time))::BIGINT FROM trips
"""


def _domain_rows(table: str, column: str, expected: list[str]) -> str:
    listed = ", ".join(f"('{v}')" for v in expected)
    return f"""
        SELECT '{column}' AS "check", coalesce(a.value, e.value) AS value,
               CASE WHEN a.value IS NULL THEN 'missing' WHEN e.value IS NULL THEN 'unexpected'
                    ELSE 'expected' END AS verdict, coalesce(n, 0)::BIGINT AS n
        FROM (SELECT trim({column}) AS value, count(*) AS n FROM {table}
              WHERE {column} IS NOT NULL GROUP BY 1) a
        FULL JOIN (VALUES {listed}) e(value) ON a.value = e.value"""


_DOMAINS = " UNION ALL ".join(
    [
        _domain_rows("profiles", "current_tier", TIERS),
        _domain_rows("trips", "trip_type", TRIP_TYPES),
        _domain_rows("interactions", "event_type", EVENT_TYPES),
    ]
)
_LOGS = ("profiles", "sessions", "trips", "incentives", "interactions")


def _share_sql(table: str, column: str) -> str:
    return f"""SELECT {column}, count(*)::BIGINT AS n,
                      count(*)::DOUBLE / sum(count(*)) OVER () AS share
               FROM {table} GROUP BY {column}"""


def _per_column(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def box_sql(columns: list[str], by: str | None, places: int, table: str = "features") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    block = (
        "SELECT " + key + "'{c}' AS \"column\", q1, median, q3, "
        "min({c}) FILTER ({c} BETWEEN lo AND hi) AS whisker_low, "
        "max({c}) FILTER ({c} BETWEEN lo AND hi) AS whisker_high, "
        "(count(*) FILTER ({c} NOT BETWEEN lo AND hi))::BIGINT AS outliers, "
        "count({c})::BIGINT AS n "
        f"FROM {table} JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        "(SELECT " + key + "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({{c}}, 0.75) AS q3 FROM {table} {group})) {using} "
        f"GROUP BY ALL"
    )
    outer = ", ".join(f"{rounded(c, places)} AS {c}" for c in BOX_COLUMNS)
    return f'SELECT {key}"column", {outer}, outliers, n FROM ({_per_column(block, columns)})'


def _melted(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{c.strip('"')}' AS "column", {c}::DOUBLE AS v FROM {table}"""
        for c in columns
    )


_STATS_SQL = ", ".join(
    ["count(v)::BIGINT AS n"]
    + [
        f"{rounded(text, 3)} AS {name}"
        for text, name in (
            ("avg(v)", "mean"),
            ("stddev_samp(v)", "std"),
            ("min(v)", "min"),
            ("quantile_cont(v, 0.25)", "q1"),
            ("quantile_cont(v, 0.5)", "median"),
            ("quantile_cont(v, 0.75)", "q3"),
            ("max(v)", "max"),
        )
    ]
)
_MELTED = _per_column("SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM features", PROFILED)

ORACLE = {
    "null_audit": sql(_NULLS, *_LOGS),
    "label_balance": sql(_share_sql("profiles", '"Churned"'), "profiles"),
    "temporal_violations": sql(
        f"""SELECT "check", CASE bad_rows WHEN 0 THEN 'PASS' ELSE 'FAIL' END AS status, bad_rows
            FROM ({_ORDER_RULES})""",
        *_LOGS,
    ),
    "domain_check": sql(_DOMAINS, *_LOGS),
    "quality_suite": sql(
        f"""SELECT "check", CASE bad_rows WHEN 0 THEN 'PASS' ELSE 'FAIL' END AS status, bad_rows
            FROM (SELECT 'no NULL in ' || "table" AS "check", sum(nulls)::BIGINT AS bad_rows
                  FROM ({_NULLS}) GROUP BY "table"
                  UNION ALL {_ORDER_RULES}
                  UNION ALL SELECT 'domain of ' || "check",
                                   coalesce(sum(n) FILTER (verdict = 'unexpected'), 0)::BIGINT
                  FROM ({_DOMAINS}) GROUP BY "check")""",
        *_LOGS,
    ),
    "tier_value_counts": sql(_share_sql("profiles", "current_tier"), "profiles"),
    "describe_exact": sql(
        f'SELECT "column", {_STATS_SQL} FROM ({_melted("features", DESCRIBED)}) GROUP BY "column"',
        "features",
    ),
    "describe_raw": sql(
        f"""SELECT "table", "column", {_STATS_SQL}
            FROM ({" UNION ALL ".join(_melted(t, c) for t, c in RAW_DESCRIBED.items())})
            GROUP BY "table", "column" """,
        *RAW_DESCRIBED,
    ),
    "histogram_30": sql(
        f"""SELECT "column", bin, coalesce(n, 0)::BIGINT AS n
            FROM (SELECT DISTINCT "column", unnest(range(30))::INT AS bin FROM ({_MELTED}))
            LEFT JOIN (
              SELECT "column", CAST(least(floor((v - low) / (high - low) * 30), 29) AS INT) AS bin,
                     count(*) AS n
              FROM ({_MELTED})
              JOIN (SELECT "column", min(v) AS low, max(v) AS high FROM ({_MELTED}) GROUP BY 1)
                USING ("column")
              WHERE v IS NOT NULL GROUP BY 1, 2) USING ("column", bin)""",
        "features",
    ),
    "box_stats": sql(box_sql(BOXED, None, 6), "features"),
    "box_stats_by_label": sql(box_sql(BY_LABEL, '"Churned"', 3), "features"),
    "corr_matrix": sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {rounded(f'corr({a}, {b})', 6)} AS r FROM features"
            for a in CORRELATION_FEATURES
            for b in CORRELATION_FEATURES
        ),
        "features",
    ),
    "kde_grid": sql(
        f"""SELECT "column", point, {rounded("low + (high - low) / 199 * point", 3)} AS x,
                   {rounded("sum(exp(-0.5 * pow((low + (high - low) / 199 * point - v) / h, 2)))"
                            " / (any_value(n) * sqrt(2 * pi()))", 9)} AS density_times_bandwidth,
                   {rounded("any_value(h)", 6)} AS bandwidth
            FROM (SELECT *, unnest(range(200))::INT AS point,
                         sd * pow(n::DOUBLE, -0.2) AS h
                  FROM (SELECT "column", min(v) AS low, max(v) AS high, count(v) AS n,
                               stddev_samp(v) AS sd FROM ({_MELTED}) GROUP BY 1)
                  WHERE n > 1 AND sd > 0)
            JOIN ({_MELTED}) m USING ("column")
            WHERE v IS NOT NULL
            GROUP BY "column", point, low, high""",
        "features",
    ),
}
