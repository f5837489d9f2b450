"""Writers. Every one is a single distributed write; nothing passes the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.sources import schemas
from fleetcohort.sources.raw import open_optional, open_required

#: Bytes of a row group in tables that single rows are looked up in.
LOOKUP_BLOCK = 8 << 20


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the whole table at ``path``."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Replace the table, ordered by ``key`` and with Bloom filters on it: a look-up of one key
    reads one row group of one file, found by the files' ranges or, for text keys in any
    order, by the filters."""
    (
        df.repartitionByRange(key)
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.block.size", LOOKUP_BLOCK)
        .parquet(path)
    )


def write_week(df: DataFrame, path: str) -> None:
    """Replace only the ``week`` partitions present in ``df``; a re-run is idempotent."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("week")
        .parquet(path)
    )


def append_dispatch_log(
    outbox: DataFrame, path: str, stamp: Column | None = None, batch: str | None = None
) -> None:
    """Add a batch of dispatch rows, stamped at write time or with ``stamp``, exactly once.

    Rows of an attempt are written first, then the attempt is entered in the log's manifest.
    Readers follow the manifest: an attempt that died half-way is never seen, and when a batch
    (a week) is run again its newest attempt stands for it. Without a name every call is a batch
    of its own.
    """
    attempt = uuid.uuid4().hex
    write_attempt(outbox, path, batch or attempt, attempt, stamp)
    entry = [(batch or attempt, attempt)]
    (
        outbox.sparkSession.createDataFrame(entry, "batch string, attempt string")
        .withColumn("committed", F.current_timestamp())
        .coalesce(1)
        .write.mode("append")
        .parquet(f"{path}/manifest")
    )


def write_attempt(outbox: DataFrame, path: str, batch: str, attempt: str, stamp: Column | None = None) -> None:
    """The rows of an attempt, not yet part of the log."""
    (
        outbox.withColumn("timestamp", F.current_timestamp() if stamp is None else stamp)
        .select(*schemas.DISPATCH_LOG.fieldNames(), F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
        .write.mode("append")
        .partitionBy("batch", "attempt")
        .parquet(f"{path}/rows")
    )


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "recipient", "type", "subject")


def read_dispatch_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each batch's newest committed attempt, newest first; an absent log is empty."""
    manifest = open_optional(spark, f"{path}/manifest", schema=schemas.DISPATCH_MANIFEST)
    if manifest is None:
        return newest_first(spark.createDataFrame([], schemas.DISPATCH_LOG))
    newest = F.max_by("attempt", F.struct("committed", "attempt"))
    # A row per batch; the join prunes the folders of other attempts.
    standing = manifest.groupBy("batch").agg(newest.alias("attempt"))
    rows = open_required(spark, f"{path}/rows", schema=schemas.DISPATCH_ROWS)
    kept = rows.join(standing, ["batch", "attempt"], "left_semi")
    return newest_first(kept.select(*schemas.DISPATCH_LOG.fieldNames()))


def append_run_log(
    spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict
) -> None:
    """Append the parameters and metrics of one training run as key/value rows."""
    rows = [(run_id, "param", str(k), str(v)) for k, v in params.items()]
    rows += [(run_id, "metric", str(k), repr(float(v))) for k, v in metrics.items()]
    spark.createDataFrame(rows, schemas.RUN_LOG).coalesce(1).write.mode("append").parquet(path)
