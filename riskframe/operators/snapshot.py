"""Feature snapshots: latest row per entity, incremental refresh, lookup by feature references."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators.upsert import dedup_latest
from riskframe.sources.tables import append_rows, latest_version, write_version

DEFAULT_LOOKBACK_DAYS = 3650


def window_bounds(start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    end = end or datetime.now(UTC)
    start = start or end - timedelta(days=DEFAULT_LOOKBACK_DAYS)
    if start >= end:
        raise ValueError("start must be before end")
    return start, end


def materialize(df: DataFrame, key: str, ts: str, start: datetime | None = None,
                end: datetime | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Latest row per entity by event time inside [start, end]."""
    start, end = window_bounds(start, end)
    at = F.col(ts).cast("timestamp")
    return dedup_latest(df.where(at.between(F.lit(start), F.lit(end))), [key], [ts], tiebreak)


def merge_latest(snapshot: DataFrame | None, incoming: DataFrame, key: str, ts: str,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Snapshot after new rows: the later event time wins, so late old rows change nothing."""
    rows = incoming if snapshot is None else snapshot.unionByName(incoming)
    return dedup_latest(rows, [key], [ts], tiebreak)


def read_checkpoint(spark: SparkSession, path: str) -> datetime | None:
    try:
        return spark.read.parquet(f"{path}/progress").agg(F.max("end_ts")).first()[0]
    except AnalysisException as error:
        # only an absent log means "nothing yet"; a damaged one must not be written over
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def materialize_incremental(df: DataFrame, path: str, key: str, ts: str, end: datetime | None = None,
                            tiebreak: Sequence[str] = ()) -> datetime:
    """Merge the rows newer than the stored checkpoint into the snapshot table at ``path``."""
    spark = df.sparkSession
    end = end or datetime.now(UTC)
    last = read_checkpoint(spark, path)
    at = F.col(ts).cast("timestamp")
    fresh = df.where(at <= F.lit(end))
    if last is not None:
        fresh = fresh.where(at > F.lit(last))
    merged = merge_latest(latest_version(spark, path), fresh, key, ts, tiebreak)
    write_version(merged, path, end)
    append_rows(spark.range(1).select(F.lit(end).cast("timestamp").alias("end_ts")), f"{path}/progress")
    return end


def resolve_refs(refs: Sequence[str] | None = None) -> list[str]:
    """Column names of ``view:feature`` references; unknown ones are refused."""
    out = []
    for ref in refs if refs is not None else S.ALL_FEATURE_REFS:
        view, _, col = ref.partition(":")
        if col not in S.FEATURE_VIEWS.get(view, []):
            raise ValueError(f"unknown feature reference: {ref}")
        out.append(col)
    return out


def get_features(ids: DataFrame, snapshot: DataFrame, key: str, refs: Sequence[str] | None = None,
                 ts: str | None = None, asof: datetime | None = None,
                 ttl_days: int = S.FEATURE_TTL_DAYS) -> DataFrame:
    """One row per requested id with the referenced features; absent or expired ones are NULL."""
    cols = resolve_refs(refs)
    absent = [c for c in cols if c not in snapshot.columns]
    if refs is not None and absent:
        raise ValueError(f"the snapshot lacks {absent}")
    cols = [c for c in cols if c not in absent]
    side = snapshot.select(key, *cols, *([ts] if ts else []))
    if ts is not None:
        oldest = (asof or datetime.now(UTC)) - timedelta(days=ttl_days)
        alive = F.col(ts).cast("timestamp") >= F.lit(oldest)
        side = side.select(key, *[F.when(alive, F.col(c)).alias(c) for c in cols])
    return ids.select(key).join(side, key, "left")


def lookup(spark: SparkSession, ids: Sequence, snapshot: DataFrame, key: str, **kwargs) -> DataFrame:
    """``get_features`` for a list of ids."""
    if not ids:
        raise ValueError("no ids given")
    kind = dict(snapshot.dtypes)[key]
    frame = spark.createDataFrame([(i,) for i in ids], f"{key} {kind}")
    return get_features(frame, snapshot, key, **kwargs)


def with_presence(features: DataFrame, key: str, out: str = "is_present") -> DataFrame:
    """Flag rows with at least one non-NULL feature."""
    cols = [c for c in features.columns if c != key]
    return features.withColumn(out, F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())
