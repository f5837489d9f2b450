"""The five raw logs derived from the TPC-H-like test tables.

``customer`` is the spine; orders stand in for sessions and incentives, line items
for trips, app events for interactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.sources.raw import RawLogs

# Pinned, so that opening a table reads no file footer.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Churned: the last order lies more than 270 days before the newest order of all."""
    orders = table(spark, folder, "orders")
    history = orders.groupBy(F.col("o_custkey").alias("driver_id")).agg(
        F.expr("CAST(min(o_orderdate) AS DATE)").alias("signup_date"),
        F.max("o_orderdate").alias("last_order"),
    )
    newest = orders.select(F.max("o_orderdate")).scalar()
    base = table(spark, folder, "customer").selectExpr(
        "c_custkey AS driver_id",
        """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'UberX,Premier'
                             WHEN 'MACHINERY' THEN 'UberX,uberblack'
                             ELSE 'UberX,Comfort' END AS vehicle_dispatchability""",
        "4D + (c_custkey % 11) / 10D AS avg_rating",
        """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Diamond' WHEN 'BUILDING' THEN 'Platinum'
                             WHEN 'FURNITURE' THEN 'Gold' WHEN 'HOUSEHOLD' THEN 'Blue'
                             ELSE 'Unknown' END AS current_tier""",
    )
    return (
        base.join(history, "driver_id", "left")
        .withColumn("newest", newest)
        .selectExpr(
            "driver_id",
            "signup_date",
            "vehicle_dispatchability",
            "avg_rating",
            "current_tier",
            "CASE WHEN timestampdiff(DAY, last_order, newest) > 270 THEN 1 ELSE 0 END AS Churned",
        )
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    start = "timestampadd(SECOND, CAST(o_orderkey * 6007 % 86400 AS INT), o_orderdate)"
    length = "CAST((o_orderkey % 12 + 1) * 1800 AS INT)"
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS session_id",
        "o_custkey AS driver_id",
        f"{start} AS session_start",
        f"timestampadd(SECOND, {length}, {start}) AS session_end",
    )


def trips(spark: SparkSession, folder: str) -> DataFrame:
    joined = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    )
    second = "CAST((l_orderkey * 7919 + l_linenumber * 3571) % 86400 AS INT)"
    return joined.selectExpr(
        "l_orderkey * 10 + l_linenumber AS trip_id",
        "o_custkey AS driver_id",
        f"timestampadd(SECOND, {second}, l_shipdate) AS request_time",
        f"timestampadd(SECOND, {second} + 300, l_shipdate) AS pickup_time",
        "CAST(l_quantity * 60 AS BIGINT) AS trip_duration_seconds",
        "l_extendedprice AS fare",
        "floor(l_extendedprice * l_tax * 100) / 100D AS tip",
        "l_discount * 10 + 1D AS surge_multiplier",
        """CASE p_type WHEN 'PROMO' THEN 'UberBlack' WHEN 'LARGE' THEN 'Premier'
                       WHEN 'STANDARD' THEN 'Comfort' WHEN 'SMALL' THEN 'Electric'
                       ELSE 'UberX' END AS trip_type""",
    )


def incentives(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS incentive_id",
        "o_custkey AS driver_id",
        "IF(o_orderpriority IN ('1-URGENT', '2-HIGH'), 'Quest', 'Boost') AS incentive_type",
        "CAST(o_orderdate AS DATE) AS offer_date",
        """CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                              WHEN 'P' THEN 'expired' END AS status""",
        "floor(o_totalprice) / 100D AS bonus_amount",
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "user_id AS driver_id",
        "ts AS event_timestamp",
        """CASE event_type WHEN 'click' THEN 'trip_accepted' WHEN 'error' THEN 'trip_cancelled'
                           WHEN 'purchase' THEN 'trip_ignored' WHEN 'view' THEN 'app_open'
                           WHEN 'signup' THEN 'heatmap_view' END AS event_type""",
    )


def raw_logs(spark: SparkSession, folder: str) -> RawLogs:
    return RawLogs(
        profiles=profiles(spark, folder),
        sessions=sessions(spark, folder),
        trips=trips(spark, folder),
        incentives=incentives(spark, folder),
        interactions=interactions(spark, folder),
    )
