"""Monitoring tables (appended once per run) and the dashboard queries on top of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions.scalar import bucket_label, month_start
from riskframe.operators.drift import KS_THRESHOLD, PSI_THRESHOLD, drift_summary
from riskframe.operators.metrics import score_histogram
from riskframe.sources.tables import append_rows


def _stamp(run_ts: datetime | None) -> Column:
    # one value for all rows of a run: the latest-run queries rely on equality
    return F.lit(run_ts or datetime.now(UTC)).cast("timestamp")


def _conform(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def metric_rows(metrics: DataFrame, name: str, run_ts: datetime | None = None) -> DataFrame:
    return _conform(metrics.withColumns({"run_ts": _stamp(run_ts), "model_name": F.lit(name)}), S.MODEL_METRIC_FIELDS)


def bin_rows(scored: DataFrame, name: str, run_ts: datetime | None = None, bins: int = 20) -> DataFrame:
    rows = score_histogram(scored, bins).withColumns({"run_ts": _stamp(run_ts), "model_name": F.lit(name)})
    return _conform(rows, S.PREDICTION_BIN_FIELDS)


def drift_rows(report: DataFrame, run_ts: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(run summary row, one row per feature), both with the same run time."""
    stamp = _stamp(run_ts)
    run = _conform(drift_summary(report).withColumn("run_ts", stamp), S.DRIFT_RUN_FIELDS)
    return run, _conform(report.withColumn("run_ts", stamp), S.FEATURE_DRIFT_FIELDS)


def append_metrics(root: str, metrics: DataFrame, name: str, scored: DataFrame | None = None,
                   run_ts: datetime | None = None) -> datetime:
    """Append an evaluation: metric row, and the score histogram when scores are given."""
    run_ts = run_ts or datetime.now(UTC)
    append_rows(metric_rows(metrics, name, run_ts), f"{root}/model_metrics")
    if scored is not None:
        append_rows(bin_rows(scored, name, run_ts), f"{root}/prediction_bins")
    return run_ts


def append_drift(root: str, report: DataFrame, run_ts: datetime | None = None) -> datetime:
    """Append a drift run; the report has one row per feature and is computed once."""
    run_ts = run_ts or datetime.now(UTC)
    report = report.persist()
    try:
        run, features = drift_rows(report, run_ts)
        append_rows(run, f"{root}/drift_runs")
        append_rows(features, f"{root}/feature_drift")
    finally:
        report.unpersist()
    return run_ts


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def flatten_metrics(metrics: DataFrame, run_id: str | None = None) -> DataFrame:
    """Long (metric, value) of the numeric scalars; confusion counts get a ``cm_`` prefix."""
    pairs = []
    for name, kind in metrics.dtypes:
        if name == "confusion_matrix" and kind.startswith("struct"):
            for sub in metrics.schema[name].dataType.names:
                pairs.append((f"cm_{sub}", F.col(f"{name}.{sub}")))
        elif kind in NUMERIC_TYPES or kind.startswith("decimal"):
            pairs.append((name, F.col(name)))
    rows = F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in pairs]))
    long = metrics.select(rows).where("value is not null")
    return long if run_id is None else long.select(F.lit(run_id).alias("run_id"), "metric", "value")


def append_run(root: str, run_id: str, kind: str, params: dict[str, object], metrics: DataFrame,
               run_ts: datetime | None = None) -> str:
    """Append a run log row: parameters and metrics as maps (one entry per metric name)."""
    spark = metrics.sparkSession
    entries = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    pairs = [F.lit(x) for k, v in params.items() for x in (k, str(v))]
    given = F.create_map(*pairs) if pairs else F.lit(None)
    row = entries.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), _stamp(run_ts).alias("run_ts"),
                         given.cast("map<string,string>").alias("params"), "metrics")
    append_rows(row, f"{root}/runs")
    return run_id


# ---- dashboard queries --------------------------------------------------------------------------

def recent_count(df: DataFrame, ts: str, asof: datetime | Column, hours: int = 24) -> DataFrame:
    at = asof if isinstance(asof, Column) else F.lit(asof)
    since = at.cast("timestamp") - F.expr(f"interval {hours} hours")
    return df.where(F.col(ts).cast("timestamp") >= since).agg(F.count(F.lit(1)).alias("scored"))


def latest_row(df: DataFrame, ts: str = "run_ts") -> DataFrame:
    return df.orderBy(F.col(ts).desc()).limit(1)


def latest_drift_status(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select(F.col("dataset_drift").cast("int").alias("status"))


def latest_n_drifted(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select("n_drifted")


def latest_metric(metrics: DataFrame, name: str = "pr_auc") -> DataFrame:
    return latest_row(metrics).select(name)


def latest_run(df: DataFrame, ts: str = "run_ts") -> DataFrame:
    """All rows of the newest run (scalar subquery on the run time)."""
    return df.where(F.col(ts) == df.agg(F.max(ts)).scalar())


def latest_features(feature_drift: DataFrame, metric: str) -> DataFrame:
    return latest_run(feature_drift).select("feature", metric).orderBy(F.desc(metric))


def latest_bins(bins: DataFrame) -> DataFrame:
    return latest_run(bins).orderBy("bin_lo").select(bucket_label("bin_lo").alias("bucket"), "count")


def rate_by_month(df: DataFrame, date: str = "issue_d", flag: str = S.TARGET) -> DataFrame:
    """Mean of a 0/1 flag per month, unknown outcomes left out."""
    return (df.where(F.col(flag).isNotNull()).groupBy(month_start(date).alias("time"))
            .agg(F.avg(F.col(flag).cast("double")).alias("default_rate")).orderBy("time"))


def metric_trend(metrics: DataFrame, names: Sequence[str] = ("roc_auc", "pr_auc", "ks_statistic")) -> DataFrame:
    return metrics.select(F.col("run_ts").alias("time"), *names).orderBy("time")


def drift_alerts(feature_drift: DataFrame, psi: float = PSI_THRESHOLD, ks: float = KS_THRESHOLD) -> DataFrame:
    newest = latest_run(feature_drift).where((F.col("psi") >= psi) | (F.col("ks_statistic") >= ks))
    return newest.select("feature", "psi", "ks_statistic").orderBy(F.desc("psi"))
