"""Sinks: Parquet tables, versioned upsert targets, appended run tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.upsert import upsert

def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full rewrite of a table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A metric row as one JSON file; the frame is one row by construction."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _commits(spark: SparkSession, path: str) -> int:
    """Last committed version of a versioned table, 0 before the first write."""
    try:
        log = spark.read.schema("version int, committed_at timestamp").parquet(f"{path}/commits")
        return log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except AnalysisException as error:
        # only an absent log means "nothing yet"; a damaged one must not be written over
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the newest committed version, or None before the first write."""
    version = _commits(spark, path)
    return read_version(spark, path, version) if version else None


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Rows of one version, committed or not."""
    return spark.read.parquet(f"{path}/data/version={version}")


def stage_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write ``df`` as the next version without committing it; readers still see the one before."""
    version = _commits(df.sparkSession, path) + 1
    write_table(df, f"{path}/data/version={version}", partition_by)
    return version


def commit_version(spark: SparkSession, path: str, version: int, now: datetime | None = None) -> None:
    """Make a staged version the newest one."""
    row = spark.range(1).select(F.lit(version).cast("int").alias("version"),
                                F.lit(now or datetime.now(UTC)).cast("timestamp").alias("committed_at"))
    append_rows(row, f"{path}/commits")


def write_version(df: DataFrame, path: str, now: datetime | None = None) -> int:
    """Write ``df`` as the next version; it counts only once its commit row is there.

    Older versions are only read, so a failed job leaves the table as it was.
    """
    version = stage_version(df, path)
    commit_version(df.sparkSession, path, version, now)
    return version


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str],
                 update_cols: Sequence[str], order_col: str | None = None,
                 ts_col: str = "loaded_at", now: datetime | None = None,
                 on_duplicate: str = "last") -> int:
    """Upsert into a versioned table and commit the merged rows as the next version."""
    now = now or datetime.now(UTC)
    base = latest_version(spark, path)
    if base is None:
        base = spark.createDataFrame([], incoming.drop(*([order_col] if order_col else [])).schema)
        if ts_col not in base.columns:
            base = base.withColumn(ts_col, F.lit(None).cast("timestamp"))
    merged = upsert(base, incoming, keys, update_cols, order_col, ts_col, now, on_duplicate)
    return write_version(merged, path, now)
