"""Materialised intermediates in the cluster's shared checkpoint folder.

Iterative fits read their input many times. Writing it once as parquet cuts the
lineage, keeps column pruning and survives the loss of an executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="fleetcohort-")
    return _local_roots[app]


def _folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/fleetcohort/{spark.sparkContext.applicationId}"


def _written(df: DataFrame, label: str) -> str:
    path = f"{_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that scans the written copy."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, label))


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``stage``, for the length of a ``with`` block; the copy is deleted after it."""
    path = _written(df, label)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged; call when no staged frame is needed."""
    _delete(spark, _folder(spark))
