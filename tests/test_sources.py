"""Readers, writers, staging."""

import pytest
from pyspark.sql import functions as F

from fleetcohort.plans import features, quality
from fleetcohort.sources import fixture, schemas, sinks, staging
from fleetcohort.sources.raw import (
    RAW_FILES,
    MissingSource,
    absent_logs,
    load_raw_logs,
    numeric_columns,
    open_optional,
    open_required,
    require_columns,
    select_present,
)


def _write_raw(spark, folder, root, fmt, skip=()):
    logs = fixture.raw_logs(spark, folder)
    for field, (stem, schema) in RAW_FILES.items():
        if field in skip:
            continue
        df = getattr(logs, field)
        for column in schema:
            known = F.col(column.name) if column.name in df.columns else F.lit(None)
            df = df.withColumn(column.name, known.cast(column.dataType))
        df = df.select(*schema.fieldNames())
        suffix = ".csv" if fmt == "csv" else ""
        sinks.write_table(df, f"{root}/{stem}{suffix}", fmt)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_stored_logs_give_the_same_features(spark, tiny, tmp_path, fmt):
    _write_raw(spark, tiny, str(tmp_path), fmt)
    logs = load_raw_logs(spark, str(tmp_path), fmt)
    assert logs.trips.schema == schemas.TRIPS
    stored = features.driver_features(logs).withColumn("driver_id", F.col("driver_id").cast("bigint"))
    direct = features.driver_features(fixture.raw_logs(spark, tiny))
    rounding = [F.round(c, 9).alias(c) for c in numeric_columns(direct)]
    assert stored.select(*rounding).exceptAll(direct.select(*rounding)).count() == 0
    assert stored.count() == direct.count()


def test_missing_logs_are_all_named(spark, tiny, tmp_path):
    _write_raw(spark, tiny, str(tmp_path), "parquet")
    with pytest.raises(MissingSource) as error:
        load_raw_logs(spark, str(tmp_path), "csv")
    assert all(stem in str(error.value) for stem, _ in RAW_FILES.values())


def test_bad_cell_fails_the_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("event_id,driver_id,event_timestamp,event_type\n1,2,not a time,app_open\n")
    df = open_required(spark, str(tmp_path / "x.csv"), "csv", schemas.INTERACTIONS)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        df.collect()


def test_optional_source(spark, tmp_path):
    assert open_optional(spark, str(tmp_path / "absent")) is None
    with pytest.raises(MissingSource):
        open_required(spark, str(tmp_path / "absent"))


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, y string, z double")
    assert select_present(df, ["z", "nope", "x"]).columns == ["z", "x"]
    assert numeric_columns(df, exclude=["x"]) == ["z"]
    with pytest.raises(KeyError, match="nope"):
        require_columns(df, ["x", "nope"])


def test_week_rerun_replaces_only_its_week(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(week, values):
        rows = [(v, week) for v in values]
        sinks.write_week(spark.createDataFrame(rows, "v int, week string"), path)

    put("2024-06-03", [1, 2])
    put("2024-06-10", [3])
    put("2024-06-03", [9])
    got = {(r["v"], str(r["week"])) for r in spark.read.parquet(path).collect()}
    assert got == {(9, "2024-06-03"), (3, "2024-06-10")}


def test_dispatch_log_appends_and_reads_newest_first(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.read_dispatch_log(spark, path).count() == 0
    for name in ("first", "second"):
        row = spark.createDataFrame([(name, "s", "nudge:X", "skipped", "")], "recipient string, subject string, type string, status string, error string")
        sinks.append_dispatch_log(row, path)
    rows = sinks.read_dispatch_log(spark, path).collect()
    assert [r["recipient"] for r in rows] == ["second", "first"]
    assert rows[0].asDict().keys() == set(schemas.DISPATCH_LOG.fieldNames())


def test_dispatch_log_counts_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "recipient string, subject string, type string, status string, error string"

    def outbox(*names):
        return spark.createDataFrame([(n, "s", "nudge:X", "skipped", "") for n in names], schema)

    def logged():
        return sorted(r["recipient"] for r in sinks.read_dispatch_log(spark, path).collect())

    # An attempt that died before its commit is not there, nor after its retry.
    sinks.write_attempt(outbox("a", "b"), path, "2024-06-03", "died")
    assert logged() == []
    sinks.append_dispatch_log(outbox("a", "b"), path, batch="2024-06-03")
    assert logged() == ["a", "b"]
    sinks.append_dispatch_log(outbox("c"), path, batch="2024-06-10")
    # A re-run stands for the week, whatever it sends now; another batch stays.
    sinks.append_dispatch_log(outbox("b", "d", "e"), path, batch="2024-06-03")
    assert logged() == ["b", "c", "d", "e"]
    sinks.append_dispatch_log(outbox(), path, batch="2024-06-03")
    assert logged() == ["c"]


@pytest.mark.parametrize("wanted", ["d0012345", "d0099999", "nobody"])
def test_one_driver_reads_one_row_group(spark, tmp_path, monkeypatch, wanted):
    from fleetcohort.plans.reports import driver_record

    path = str(tmp_path / "lookup")
    monkeypatch.setattr(sinks, "LOOKUP_BLOCK", 64 << 10)
    df = spark.range(100_000).selectExpr("concat('d', lpad(CAST(id AS STRING), 7, '0')) AS driver_id", "md5(CAST(id AS STRING)) AS note")
    sinks.write_by_key(df.repartition(4), path, "driver_id")
    found = driver_record(spark.read.schema(df.schema).parquet(path), wanted)
    plan = found._jdf.queryExecution().executedPlan()
    assert "EqualTo(driver_id" in plan.toString()
    rows = found.collect()
    assert [r["driver_id"] for r in rows] == ([] if wanted == "nobody" else [wanted])
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 20_000


def test_a_report_without_one_of_its_logs(spark, tiny, tmp_path):
    from fleetcohort.plans import reports

    logs = fixture.raw_logs(spark, tiny)
    _write_raw(spark, tiny, str(tmp_path), "parquet", skip=["incentives"])
    with pytest.raises(MissingSource, match="incentive"):
        load_raw_logs(spark, str(tmp_path), "parquet")
    some = load_raw_logs(spark, str(tmp_path), "parquet", optional=["incentives"])
    assert absent_logs(some, "trips", "incentives") == ["incentives"]
    segmented = spark.createDataFrame([("a", "Quest Grinder")], "driver_id string, persona string")
    report = reports.earnings_composition(segmented, some)
    assert report.dtypes == reports.earnings_composition(segmented, logs).dtypes
    rows = report.collect()
    assert len(rows) == 4 and all(r["pct"] is None and r["note"] == "unavailable: no incentives" for r in rows)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.append_run_log(spark, path, "r1", {"maxDepth": 4}, {"auc": 0.75})
    sinks.append_run_log(spark, path, "r2", {"maxDepth": 5}, {"auc": 0.5})
    rows = {(r["run_id"], r["kind"], r["key"], r["value"]) for r in spark.read.parquet(path).collect()}
    assert ("r1", "metric", "auc", "0.75") in rows and ("r2", "param", "maxDepth", "5") in rows
    assert len(rows) == 4


def test_staged_copy_is_a_plain_scan(spark):
    df = staging.stage(spark.range(10).withColumn("x", F.rand(1)), "t")
    assert df.count() == 10
    assert df.collect() == df.collect()
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_quality_flags_bad_rows(spark, tiny):
    from datetime import datetime

    from fleetcohort.sources.raw import RawLogs

    logs = fixture.raw_logs(spark, tiny)
    t = datetime(2024, 1, 1)
    bad_sessions = spark.createDataFrame(
        [("s1", "d", t, t), ("s2", "d", t, datetime(2024, 1, 2)), ("s3", None, t, datetime(2023, 1, 1))],
        schemas.SESSIONS,
    )
    bad_events = spark.createDataFrame([("e", "d", t, "teleport"), ("e", "d", t, None)], schemas.INTERACTIONS)
    suite = quality.quality_suite(
        RawLogs(logs.profiles, bad_sessions, logs.trips, logs.incentives, bad_events)
    )
    rows = {r["check"]: (r["status"], r["bad_rows"]) for r in suite.collect()}
    assert rows["session_end after session_start"] == ("FAIL", 2)
    assert rows["no NULL in sessions"] == ("FAIL", 1)
    assert rows["domain of event_type"] == ("FAIL", 1)
    assert rows["pickup_time after request_time"] == ("PASS", 0)
    assert rows["domain of current_tier"][0] == "FAIL"  # 'Unknown' in the test tables
    assert quality.violating_rows(bad_sessions, "session_start", "session_end").count() == 2
