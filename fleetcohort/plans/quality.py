"""Data-quality checks on the raw logs, as tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.settings import EVENT_TYPES, TIERS, TRIP_TYPES
from fleetcohort.sources.raw import RawLogs


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _tables(logs: RawLogs) -> dict[str, DataFrame]:
    return {
        "profiles": logs.profiles,
        "sessions": logs.sessions,
        "trips": logs.trips,
        "incentives": logs.incentives,
        "interactions": logs.interactions,
    }


def table_facts(df: DataFrame, **rules: Column) -> DataFrame:
    """One row from one pass: row count, NULLs per column, rows matching each rule."""
    return df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
        *[F.count_if(rule).alias(f"_rule_{name}") for name, rule in rules.items()],
    )


def column_audit(table: str, df: DataFrame) -> DataFrame:
    """Type, row count and NULL count of every column in one pass over the table."""
    kinds = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, kind)])
    return table_facts(df).unpivot(["_rows"], df.columns, "column", "nulls").select(
        F.lit(table).alias("table"),
        "column",
        kinds[F.col("column")].alias("type"),
        F.col("_rows").alias("rows"),
        "nulls",
    )


def null_audit(logs: RawLogs) -> DataFrame:
    return _stack([column_audit(name, df) for name, df in _tables(logs).items()])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of every non-NULL value. The grouped counts are reused for the total."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total)


def label_balance(profiles: DataFrame) -> DataFrame:
    return value_counts(profiles, "Churned")


def _order_rule(check: str, df: DataFrame, start: str, end: str) -> DataFrame:
    bad = F.count_if(F.col(end) <= F.col(start))
    return df.agg(bad.alias("bad_rows")).select(F.lit(check).alias("check"), "bad_rows")


def temporal_violations(logs: RawLogs) -> DataFrame:
    """Rows whose end is not after their start, per rule."""
    found = _stack(
        [
            _order_rule("session_end after session_start", logs.sessions, "session_start", "session_end"),
            _order_rule("pickup_time after request_time", logs.trips, "request_time", "pickup_time"),
        ]
    )
    return found.select("check", _status("bad_rows"), "bad_rows")


def violating_rows(df: DataFrame, start: str, end: str) -> DataFrame:
    """The offending rows themselves."""
    return df.filter(F.col(end) <= F.col(start))


def _status(column: str):
    return F.when(F.col(column) == 0, "PASS").otherwise("FAIL").alias("status")


def _domain(check: str, df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    value = F.trim(F.col(column))
    actual = (
        df.filter(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    wanted = df.sparkSession.createDataFrame([(v,) for v in expected], "value string").withColumn(
        "expected", F.lit(True)
    )
    verdict = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .otherwise("expected")
    )
    return actual.join(wanted, "value", "full").select(
        F.lit(check).alias("check"),
        "value",
        verdict.alias("verdict"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def domain_check(logs: RawLogs) -> DataFrame:
    """Every actual or expected value of the three coded columns with its verdict."""
    return _stack(
        [
            _domain("current_tier", logs.profiles, "current_tier", TIERS),
            _domain("trip_type", logs.trips, "trip_type", TRIP_TYPES),
            _domain("event_type", logs.interactions, "event_type", EVENT_TYPES),
        ]
    )


# Table -> check -> rule that marks a bad row.
def _rules() -> dict[str, dict[str, Column]]:
    def outside(column: str, expected: list[str]) -> Column:
        return F.col(column).isNotNull() & ~F.trim(F.col(column)).isin(expected)

    return {
        "profiles": {"domain of current_tier": outside("current_tier", TIERS)},
        "sessions": {
            "session_end after session_start": F.col("session_end") <= F.col("session_start")
        },
        "trips": {
            "pickup_time after request_time": F.col("pickup_time") <= F.col("request_time"),
            "domain of trip_type": outside("trip_type", TRIP_TYPES),
        },
        "incentives": {},
        "interactions": {"domain of event_type": outside("event_type", EVENT_TYPES)},
    }


def quality_suite(logs: RawLogs) -> DataFrame:
    """One row per check: NULLs per table, order rules, domain rules. Each log is read once."""
    rules = _rules()
    verdicts = []
    for table, df in _tables(logs).items():
        named = {f"r{i}": rule for i, rule in enumerate(rules[table].values())}
        nulls = reduce(add, [F.col(c) for c in df.columns])
        lines = [F.struct(F.lit(f"no NULL in {table}").alias("check"), nulls.alias("bad_rows"))]
        lines += [
            F.struct(F.lit(check).alias("check"), F.col(f"_rule_r{i}").alias("bad_rows"))
            for i, check in enumerate(rules[table])
        ]
        verdicts.append(table_facts(df, **named).select(F.inline(F.array(*lines))))
    return _stack(verdicts).select("check", _status("bad_rows"), "bad_rows")
