"""Edge rows of every feature, and the invariants of the feature table."""

import math
from datetime import date, datetime, timedelta
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from fleetcohort.plans import features
from fleetcohort.settings import FEATURE_COLUMNS
from fleetcohort.sources import schemas
from fleetcohort.sources.raw import RawLogs

T0 = datetime(2024, 6, 5, 12, 0, 0)


def profiles(spark, rows):
    full = [
        (d, date(2020, 1, 1), disp, 4.5, tier, 0) for d, disp, tier in rows
    ]
    return spark.createDataFrame(full, schemas.PROFILES)


def sessions(spark, rows):
    full = [(f"s{i:04d}", d, a, b) for i, (d, a, b) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.SESSIONS)


def trips(spark, rows):
    """(driver, request, seconds, fare, tip, surge, type)"""
    full = [
        (f"t{i}", d, at, at, sec, fare, tip, surge, 0.0, 0.0, 0.0, 0.0, kind)
        for i, (d, at, sec, fare, tip, surge, kind) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.TRIPS)


def incentives(spark, rows):
    full = [(f"i{i}", d, kind, date(2024, 1, 1), st, amt) for i, (d, kind, st, amt) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.INCENTIVES)


def interactions(spark, rows):
    full = [(f"e{i}", d, T0, kind) for i, (d, kind) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.INTERACTIONS)


def by_driver(df):
    return {r["driver_id"]: r for r in df.collect()}


def trip(d, at=T0, sec=600, fare=10.0, tip=0.0, surge=1.0, kind="UberX"):
    return (d, at, sec, fare, tip, surge, kind)


@pytest.fixture(scope="module")
def table(spark):
    hour = timedelta(hours=1)
    logs = RawLogs(
        profiles=profiles(
            spark,
            [
                ("no_sessions", "UberX", "Gold"),
                ("no_trips", "UberX,uberblack", None),
                ("zero_length", None, "Diamond"),
                ("too_busy", "UberX, PREMIER", "Platinum"),
                ("normal", "UberX", "Bronze"),
                ("nothing", "Comfort", "Blue"),
            ],
        ),
        sessions=sessions(
            spark,
            [
                ("no_trips", T0, T0 + hour),
                ("zero_length", T0, T0),
                ("too_busy", T0, T0 + hour),
                ("normal", T0, T0 + 2 * hour),
            ],
        ),
        trips=trips(
            spark,
            [
                trip("no_sessions"),
                trip("zero_length"),
                trip("too_busy", sec=9000),
                trip("normal", fare=14.0, tip=1.0, surge=1.4),
                trip("normal", fare=14.0, tip=None, surge=1.4),
                trip("normal", fare=99.0, tip=1.0, surge=0.0, kind="UberBlack"),
                trip("normal", fare=99.0, tip=1.0, surge=None, kind="Premier"),
            ],
        ),
        incentives=incentives(
            spark,
            [
                ("no_trips", "Boost", "completed", 50.0),
                ("normal", "Quest", "completed", 20.0),
                ("normal", "Quest", "expired", 500.0),
                ("nothing", "Quest", "pending", 5.0),
            ],
        ),
        interactions=interactions(
            spark,
            [
                ("normal", "trip_ignored"),
                ("normal", "trip_ignored"),
                ("no_trips", "trip_accepted"),
                ("no_trips", "trip_cancelled"),
                ("nothing", "app_open"),
            ],
        ),
    )
    df = features.driver_features(logs)
    assert df.columns == FEATURE_COLUMNS
    return by_driver(df)


def test_one_row_per_profile(table):
    assert len(table) == 6


def test_trips_without_sessions(table):
    row = table["no_sessions"]
    assert row["avg_earnings_per_hour_online"] is None
    assert row["trip_utilization_rate"] is None
    assert row["session_count"] is None
    assert row["session_regularity"] is None
    assert row["surge_reliance_score"] == 0.0


def test_sessions_without_trips(table):
    row = table["no_trips"]
    assert row["avg_earnings_per_hour_online"] == 0.0
    assert row["trip_utilization_rate"] == 0.0
    assert row["surge_reliance_score"] is None
    assert row["premium_trip_ratio"] == 0.0
    assert row["peak_hour_driver_score"] is None


def test_zero_length_session_counts_as_fully_used(table):
    row = table["zero_length"]
    assert row["avg_earnings_per_hour_online"] is None
    assert row["trip_utilization_rate"] == 1.0


def test_utilization_is_clamped(table):
    assert table["too_busy"]["trip_utilization_rate"] == 1.0


def test_surge_uses_base_fare_and_skips_zero_and_null(table):
    assert table["normal"]["surge_reliance_score"] == pytest.approx(0.4)


def test_null_tip_drops_the_fare_from_earnings_only(table):
    # Earned: 15 + (NULL) + 100 + 100 over two hours; the fare total keeps all four.
    row = table["normal"]
    assert row["avg_earnings_per_hour_online"] == pytest.approx(215 / 2)
    fares, tips, bonus = 14 + 14 + 99 + 99, 3, 20
    assert row["incentive_reliance_pct"] == pytest.approx(bonus / (bonus + fares + tips))


def test_premium_capability_ignores_case(table):
    flags = {d: r["is_premium_capable"] for d, r in table.items()}
    assert flags["no_trips"] == 1 and flags["too_busy"] == 1
    assert flags["zero_length"] == 0 and flags["normal"] == 0


def test_premium_ratio(table):
    assert table["normal"]["premium_trip_ratio"] == 0.5


def test_quests(table):
    assert table["normal"]["quest_completion_rate"] == 0.5
    assert table["no_trips"]["quest_completion_rate"] is None  # only a Boost
    assert table["nothing"]["quest_completion_rate"] == 0.0


def test_reliance(table):
    assert table["no_trips"]["incentive_reliance_pct"] == 1.0  # completed Boost counts
    assert table["no_sessions"]["incentive_reliance_pct"] == 0.0
    assert table["nothing"]["incentive_reliance_pct"] is None


def test_tiers(table):
    ranks = {d: r["pro_tier_rank"] for d, r in table.items()}
    assert ranks == {
        "no_sessions": 2,
        "no_trips": 1,
        "zero_length": 4,
        "too_busy": 3,
        "normal": 1,
        "nothing": 1,
    }


def test_rates(table):
    assert table["normal"]["cancellation_rate"] is None
    assert table["normal"]["acceptance_rate"] == 0.0
    assert table["no_trips"]["cancellation_rate"] == 0.5
    assert table["no_trips"]["acceptance_rate"] == 1.0
    assert table["nothing"]["cancellation_rate"] is None
    assert table["nothing"]["acceptance_rate"] is None


def test_reliance_full_join_keeps_both_sides(spark):
    df = features.incentive_reliance(
        incentives(spark, [("bonus_only", "Boost", "completed", 5.0)]),
        trips(spark, [trip("trip_only", fare=7.0, tip=1.0)]),
    )
    rows = by_driver(df)
    assert rows["bonus_only"]["incentive_reliance_pct"] == 1.0
    assert rows["trip_only"]["incentive_reliance_pct"] == 0.0
    assert rows["trip_only"]["total_fare_earned"] == 7.0


def _reference_regularity(spans):
    """Brute force: population of boundary-counted hour gaps in start order."""
    gaps = []
    for (_, end), (start, _) in zip(spans, spans[1:]):
        gaps.append(
            int(start.timestamp() // 3600) - int(end.timestamp() // 3600)
        )
    return stdev(gaps) if len(gaps) > 1 else 0.0


@pytest.mark.parametrize("count", [1, 2, 3, 40])
def test_regularity_by_session_count(spark, count):
    spans = [(T0 + timedelta(minutes=47 * i * i), T0 + timedelta(minutes=47 * i * i + 90)) for i in range(count)]
    row = features.session_regularity(sessions(spark, [("d", *s) for s in spans])).first()
    assert row["session_count"] == count
    assert row["session_regularity"] == pytest.approx(_reference_regularity(spans))


def test_gap_counts_hour_boundaries(spark):
    at = lambda h, m: datetime(2024, 6, 5, h, m)
    spans = [(at(9, 0), at(10, 59)), (at(11, 1), at(11, 30)), (at(11, 45), at(12, 0))]
    row = features.session_regularity(sessions(spark, [("d", *s) for s in spans])).first()
    assert row["session_regularity"] == pytest.approx(stdev([1, 0]))


def test_overlapping_sessions_give_negative_gaps(spark):
    h = timedelta(hours=1)
    spans = [(T0, T0 + 5 * h), (T0 + h, T0 + 2 * h), (T0 + 10 * h, T0 + 11 * h)]
    row = features.session_regularity(sessions(spark, [("d", *s) for s in spans])).first()
    assert row["session_regularity"] == pytest.approx(stdev([-4, 8]))


def test_heavy_driver_is_spread_and_exact(spark):
    """One driver holds a third of all sessions, many with the same start."""
    heavy = spark.range(20_000).selectExpr(
        "concat('h', lpad(id, 6, '0')) AS session_id",
        "'heavy' AS driver_id",
        "timestampadd(MINUTE, CAST(id % 5000 * 13 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS session_start",
        "timestampadd(MINUTE, CAST(id % 5000 * 13 + id % 97 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS session_end",
    )
    light = spark.range(40_000).selectExpr(
        "concat('l', lpad(id, 6, '0')) AS session_id",
        "concat('d', id % 2000) AS driver_id",
        "timestampadd(HOUR, CAST(id * 7 % 9000 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS session_start",
        "timestampadd(HOUR, CAST(id * 7 % 9000 + 1 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS session_end",
    )
    both = heavy.unionAll(light)
    both.createOrReplaceTempView("skewed_sessions")
    from fleetcohort.operators.ordering import calendar_segment

    spread = both.where("driver_id = 'heavy'").groupBy(calendar_segment(F.col("session_start"))).count()
    assert max(r["count"] for r in spread.collect()) < 4_000
    got = by_driver(features.session_regularity(both))
    plain = spark.sql(
        """SELECT driver_id, coalesce(stddev_samp(gap), 0D) AS r, count(*) AS n FROM (
             SELECT driver_id,
                    floor(unix_timestamp(session_start) / 3600)
                    - floor(unix_timestamp(lag(session_end) OVER (
                        PARTITION BY driver_id ORDER BY session_start, session_id)) / 3600) AS gap
             FROM skewed_sessions) GROUP BY driver_id"""
    )
    expected = by_driver(plain)
    assert got.keys() == expected.keys()
    for key, row in got.items():
        assert row["session_count"] == expected[key]["n"]
        assert row["session_regularity"] == pytest.approx(expected[key]["r"], abs=1e-9)


def test_gaps_over_empty_weeks_and_rows_without_a_start(spark):
    rows = [
        ("s1", "a", "2024-01-01 10:00:00", "2024-01-01 11:00:00"),
        ("s2", "a", "2024-05-01 10:00:00", "2024-05-01 11:00:00"),  # 121 days later
        ("s3", "a", "2024-05-01 12:00:00", "2024-05-20 11:00:00"),
        ("s4", "a", "2024-05-20 13:00:00", "2024-05-20 14:00:00"),
        ("s5", "b", None, "2024-01-01 00:00:00"),
        ("s6", "b", "2024-01-01 03:00:00", None),
        ("s7", "b", "2024-03-01 03:00:00", "2024-03-01 04:00:00"),
    ]
    table = spark.createDataFrame(rows, "session_id string, driver_id string, s string, e string").select(
        "session_id", "driver_id", F.col("s").cast("timestamp_ntz").alias("session_start"), F.col("e").cast("timestamp_ntz").alias("session_end")
    )
    totals = by_driver(features.session_totals(table))
    gaps = [121 * 24 - 1, 1, 2]
    assert (totals["a"]["gap_count"], totals["a"]["gap_sum"]) == (3, sum(gaps))
    assert totals["a"]["gap_squares"] == sum(g * g for g in gaps)
    # From the row without a start to the first one; the row without an end leaves no gap after it.
    assert (totals["b"]["gap_count"], totals["b"]["gap_sum"], totals["b"]["session_count"]) == (1, 3, 3)


# Local New York times and whether they are peak.
PEAKS = [
    ("2024-06-08 02:59:59", True),  # Saturday
    ("2024-06-08 03:00:00", False),
    ("2024-06-08 12:00:00", False),
    ("2024-06-08 22:00:00", True),
    ("2024-06-09 12:00:00", True),  # Sunday
    ("2024-06-09 14:00:00", False),
    ("2024-06-10 01:00:00", False),  # Monday
    ("2024-06-10 07:00:00", True),
    ("2024-06-10 09:59:59", True),
    ("2024-06-10 10:00:00", False),
    ("2024-06-10 18:59:59", True),
    ("2024-06-10 19:00:00", False),
    ("2024-06-14 09:30:00", False),  # Friday
    ("2024-06-14 08:59:59", True),
    ("2024-06-14 16:00:00", True),
    ("2024-06-14 23:59:59", True),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_peak_windows(spark, zone):
    """The session's zone must not matter."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [trip(text, at=datetime.fromisoformat(text)) for text, _ in PEAKS]
        local = features.peak_hours(trips(spark, rows), source_zone="America/New_York")
        got = {d: r["peak_hour_driver_score"] == 1.0 for d, r in by_driver(local).items()}
        shifted = [trip(text, at=datetime.fromisoformat(text) + timedelta(hours=4)) for text, _ in PEAKS]
        utc = features.peak_hours(trips(spark, shifted))
        got_utc = {d: r["peak_hour_driver_score"] == 1.0 for d, r in by_driver(utc).items()}
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
    assert got == dict(PEAKS)
    assert got_utc == dict(PEAKS)


def test_local_clock_jumps_over_the_missing_hour(spark):
    from fleetcohort.functions.temporal import hour_of_day, local_epoch_seconds

    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-03-10 06:59:59'), (TIMESTAMP_NTZ '2024-03-10 07:00:00') AS t(ts)"
    )
    hours = [r[0] for r in df.select(hour_of_day(local_epoch_seconds(F.col("ts")))).collect()]
    assert hours == [1, 3]


def test_rates_stay_in_range(spark, tiny):
    from catalog.tables import stored_features

    df = stored_features(spark, tiny)
    rates = [
        "trip_utilization_rate",
        "premium_trip_ratio",
        "peak_hour_driver_score",
        "quest_completion_rate",
        "incentive_reliance_pct",
        "cancellation_rate",
        "acceptance_rate",
    ]
    row = df.agg(*[F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(c) for c in rates]).first()
    assert set(row.asDict().values()) == {0}
    assert df.count() == df.select("driver_id").distinct().count() == 150


def test_fused_table_equals_single_features(spark, tiny):
    from catalog.tables import stored_features
    from fleetcohort.sources import fixture

    fused = by_driver(stored_features(spark, tiny))
    single = by_driver(
        features.trip_utilization(fixture.sessions(spark, tiny), fixture.trips(spark, tiny))
    )
    for driver, row in single.items():
        assert row["trip_utilization_rate"] == fused[driver]["trip_utilization_rate"]
    gaps = by_driver(features.session_regularity(fixture.sessions(spark, tiny)))
    for driver, row in gaps.items():
        assert math.isclose(row["session_regularity"], fused[driver]["session_regularity"])
