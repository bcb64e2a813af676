"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from riskframe.plans.catalog import QUERIES
from riskframe.session import build_session

HEADLINE = [
    "default_rate_by_month", "loans_staging", "loan_features", "macro_features", "final_features", "clean_loans",
    "flatten_filings", "latest_load_per_member", "partial_upsert", "quality_summary", "quality_violations",
    "median_impute", "category_codes", "encoded_features", "exact_quantiles", "snapshot_latest", "feature_lookup",
    "extended_metrics", "roc_points", "score_histogram", "calibration_curve", "drift_report", "ks_two_sample",
    "drift_final_features", "fairness_audit", "decision_table", "drift_alerts", "survival_frame", "kaplan_meier",
    "concordance", "brier_scores", "step_lookup", "cox_fit", "logreg_scores", "linear_attributions",
    "tree_attributions", "counterfactuals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # starts the JVM code paths and Python workers before anything is timed
    QUERIES["default_rate_by_month"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            # a full evaluation without moving the rows to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
