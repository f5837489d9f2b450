"""Plans a large cluster can live with, checked on the physical plan."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetcohort.plans import features
from fleetcohort.sources import fixture, schemas


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_pairs_and_no_python_rows(spark, tiny, name):
    plan = plan_of(entry.queries()[name](spark, tiny))
    for banned in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert banned not in plan


def test_only_needed_columns_are_read(spark, tiny):
    plan = plan_of(features.trip_utilization(fixture.sessions(spark, tiny), fixture.trips(spark, tiny)))
    read = re.search(r"ReadSchema: struct<([^>]*l_orderkey[^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "l_partkey", "l_quantity"}


def test_filters_reach_the_scan(spark, tmp_path):
    logs = {}
    for name, schema in (("incentives", schemas.INCENTIVES), ("interactions", schemas.INTERACTIONS)):
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        logs[name] = spark.read.schema(schema).parquet(path)
    plan = plan_of(features.incentive_totals(logs["incentives"]))
    assert "PushedFilters: [Or(EqualTo(incentive_type,Quest),EqualTo(status,completed))" in plan
    counted = logs["interactions"].filter("event_type IN ('trip_accepted', 'trip_cancelled', 'trip_ignored')")
    assert "PushedFilters: [In(event_type" in plan_of(features.interaction_totals(counted))


def test_each_log_is_aggregated_once_and_only_the_spine_moves_again(spark, tiny):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    try:
        logs = fixture.raw_logs(spark, tiny)
        spine = logs.profiles.select("*")
        plan = plan_of(
            spine.join(features.trip_totals(logs.trips), "driver_id", "left").join(
                features.session_totals(logs.sessions), "driver_id", "left"
            )
        )
    finally:
        for name in names:
            spark.conf.unset(name)
    # One exchange on the driver per side: spine, trips, sessions; one of the sessions on the
    # driver and the segment before.
    assert len(re.findall(r"Exchange hashpartitioning\(driver_id#\d+L?, \d", plan)) == 3
    assert len(re.findall(r"Exchange hashpartitioning\(driver_id#\d+L?, segment", plan)) == 1
    assert "rangepartitioning" not in plan


def test_weeks_are_pruned(spark, tmp_path):
    from fleetcohort.plans.weekly import stored_week
    from fleetcohort.sources.sinks import write_week

    df = spark.range(10).withColumn("week", F.when(F.col("id") < 5, "2024-06-03").otherwise("2024-06-10"))
    write_week(df, str(tmp_path / "t"))
    week = stored_week(spark, str(tmp_path / "t"), "2024-06-03")
    assert week.count() == 5
    assert re.search(r"PartitionFilters: \[[^\]]*week", plan_of(week))


def test_session_gaps_take_one_exchange_of_the_sessions(spark, tiny):
    from fleetcohort.plans.features import session_totals

    plan = plan_of(session_totals(fixture.sessions(spark, tiny)))
    assert "rangepartitioning" not in plan
    by_segment = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "segment" in x]
    assert len(by_segment) == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 2
