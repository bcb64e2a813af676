"""End-to-end jobs: ETL, retrain, evaluation gate, fairness audit, drift check.

Each job is one Spark application over tables under a root folder:
``raw/{loans,series,filings}`` (versioned), ``mart/*``, ``monitoring/*``, ``snapshot``, ``models/*``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions.scalar import APPROVAL_THRESHOLD, label_at
from riskframe.operators import drift, fairness, metrics, models, monitor
from riskframe.operators.prep import temporal_split
from riskframe.operators.snapshot import materialize_incremental
from riskframe.plans import mart, rules
from riskframe.session import build_session
from riskframe.sources import files, tables


def ingest(spark: SparkSession, root: str, loans_csv: str | None = None, series_path: str | None = None,
           filings_path: str | None = None, now: datetime | None = None) -> None:
    """Land new files into the versioned raw tables."""
    if loans_csv is not None:
        text = files.read_csv(spark, loans_csv)
        rows = files.clean_loans(text)
        # several lines of a loan in one file apply in a fixed order of their payments
        rows = rows.withColumn("__seq", F.struct("last_pymnt_date", "total_pymnt", "loan_status"))
        tables.upsert_table(spark, f"{root}/raw/loans", rows, ["loan_id"], S.LOAN_UPDATE_COLS, "__seq", now=now)
        tables.append_rows(files.rejected_loans(text), f"{root}/raw/loan_rejects")
    if series_path is not None:
        landed = spark.read.schema("series_id string, observation_date date, value double").parquet(series_path)
        # overlapping files may repeat a key: the last row in file order wins
        landed = landed.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__seq"))
        tables.upsert_table(spark, f"{root}/raw/series", files.read_series(landed, keep=["__seq"]),
                            ["series_id", "observation_date"], ["value"], "__seq", now=now)
    if filings_path is not None:
        landed = spark.read.schema("tag string, uom string, payload string").json(filings_path)
        facts = rules.require(files.flatten_frames(landed).where("period is not null"), "raw_filings")
        tables.upsert_table(spark, f"{root}/raw/filings", facts, ["adsh", "tag", "period"], ["value"], now=now,
                            on_duplicate="error")


def _publish(spark: SparkSession, root: str, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """The written candidate is checked and then becomes the published version by one commit row."""
    path = f"{root}/mart/{name}"
    version = tables.stage_version(df, path, partition_by)
    checked = rules.require(tables.read_version(spark, path, version), name)
    tables.commit_version(spark, path, version)
    return checked


def build_mart(spark: SparkSession, root: str) -> DataFrame:
    """Check sources and staging (lazy), then write, check and publish each mart table in turn.

    A broken rule stops the run before anything that depends on the table is published.
    """
    raw_loans = rules.require(tables.latest_version(spark, f"{root}/raw/loans"), "raw_loans")
    raw_series = rules.require(tables.latest_version(spark, f"{root}/raw/series"), "raw_series")
    staged = rules.require(mart.loans_staging(raw_loans), "staging_loans")
    macro_staged = rules.require(mart.macro_staging(raw_series), "staging_macro")
    loans = _publish(spark, root, "loan_features", mart.loan_features(staged))
    macro = _publish(spark, root, "macro_features", mart.macro_features(macro_staged))
    final = mart.final_features(loans, macro).withColumn("issue_year", F.year("issue_d"))
    return _publish(spark, root, "final_features", final, ["issue_year"])


def etl(spark: SparkSession, root: str, now: datetime | None = None, **landed: str) -> DataFrame:
    """Ingest, transform, test, publish, refresh the feature snapshot."""
    ingest(spark, root, now=now, **landed)
    final = build_mart(spark, root)
    snapshot_rows = final.withColumn("event_ts", F.col("issue_d").cast("timestamp"))
    materialize_incremental(snapshot_rows, f"{root}/snapshot", "id", "event_ts", end=now)
    return final


def _final(spark: SparkSession, root: str) -> DataFrame:
    return tables.latest_version(spark, f"{root}/mart/final_features")


def run_drift_check(spark: SparkSession, root: str, cutoff: str = S.SPLIT_DATE,
                    features: Sequence[str] = tuple(S.NUMERICAL_FEATURES), persist: bool = True) -> bool:
    """Train split against test split; appends the report; True when drift was found."""
    train, test = temporal_split(_final(spark, root), cutoff=cutoff)
    report = drift.detect_drift(train, test, features).persist()
    try:
        if persist:
            monitor.append_drift(f"{root}/monitoring", report)
        return bool(drift.drift_summary(report).first()["dataset_drift"])
    finally:
        report.unpersist()


def retrain(spark: SparkSession, root: str, model_type: str = "gbt", cutoff: str = S.SPLIT_DATE,
            params: dict[str, Any] | None = None, pr_auc_min: float = metrics.PR_AUC_MIN,
            protected: dict[str, list] | None = None, run_id: str | None = None) -> dict[str, Any]:
    """Fit, evaluate, gate and audit on one scored test frame; appends metrics and run log."""
    final = _final(spark, root)
    train, test = temporal_split(final, cutoff=cutoff)
    model = models.train_credit_model(train, model_type, params)
    protected = protected or S.PROTECTED_ATTRIBUTES
    scored = model.score(test, keep=[S.TARGET, *protected]).persist()
    try:
        row = metrics.extended_metrics(scored, S.TARGET, "score").persist()
        run_ts = monitor.append_metrics(f"{root}/monitoring", row, model_type, scored)
        name = run_id or f"{model_type}-{run_ts:%Y%m%d%H%M%S}"
        monitor.append_run(f"{root}/monitoring", name, "evaluation", {**(params or {}), "cutoff": cutoff},
                           monitor.flatten_metrics(row), run_ts)
        tables.write_json(row, f"{root}/monitoring/latest_metrics")
        decided = scored.withColumn("pred_default", label_at("score", APPROVAL_THRESHOLD))
        audit = fairness.audit(decided, S.TARGET, "pred_default", protected, model_type)
        tables.append_rows(audit.withColumn("run_ts", F.lit(run_ts).cast("timestamp")), f"{root}/monitoring/fairness")
        models.save_model(model.model, f"{root}/models/{model_type}")
        return {"metrics": row.first().asDict(recursive=True),
                "passes_gate": bool(metrics.passes_gate(row, pr_auc_min).first()["passed"]),
                "passes_fairness": bool(audit.first()["overall_pass"])}
    finally:
        scored.unpersist()


def main(argv: Sequence[str] | None = None) -> int:
    """``etl``, ``retrain`` or ``drift``; exit code 1 when a gate fails."""
    parser = argparse.ArgumentParser(prog="riskframe")
    parser.add_argument("job", choices=["etl", "retrain", "drift"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--loans-csv")
    parser.add_argument("--series")
    parser.add_argument("--filings")
    parser.add_argument("--model-type", default="gbt")
    parser.add_argument("--cutoff", default=S.SPLIT_DATE)
    parser.add_argument("--pr-auc-min", type=float, default=metrics.PR_AUC_MIN)
    args = parser.parse_args(argv)
    spark = build_session("riskframe-" + args.job)
    if args.job == "etl":
        etl(spark, args.root, datetime.now(UTC), loans_csv=args.loans_csv, series_path=args.series,
            filings_path=args.filings)
        return 0
    if args.job == "drift":
        return int(run_drift_check(spark, args.root, args.cutoff))
    result = retrain(spark, args.root, args.model_type, args.cutoff, pr_auc_min=args.pr_auc_min)
    print(json.dumps(result, default=str))
    return 0 if result["passes_gate"] and result["passes_fairness"] else 1


if __name__ == "__main__":
    sys.exit(main())
