import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators import drift as D
from riskframe.operators import monitor as P
from riskframe.operators import quality as Q
from riskframe.operators import snapshot as B
from riskframe.plans import jobs
from riskframe.sources.tables import latest_version
from riskframe.streaming.incremental import read_stream, stream_snapshot, stream_upsert

UTC = dt.UTC


def at(day):
    return dt.datetime(2024, 1, day, tzinfo=UTC)


def rows(spark, *data):
    return spark.createDataFrame([(k, at(d), v) for k, d, v in data], "k string, ts timestamp, v int")


def test_windows():
    start, end = B.window_bounds(end=at(5))
    assert (end - start).days == 3650
    with pytest.raises(ValueError):
        B.window_bounds(at(5), at(5))


def test_incremental_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    first = rows(spark, ("a", 1, 1), ("a", 3, 3), ("b", 2, 2))
    B.materialize_incremental(first, path, "k", "ts", end=at(4))
    late_and_new = rows(spark, ("a", 2, 99), ("b", 5, 5), ("c", 6, 6), ("d", 20, 7))
    B.materialize_incremental(first.unionByName(late_and_new), path, "k", "ts", end=at(10))
    got = {r["k"]: r["v"] for r in latest_version(spark, path).collect()}
    assert got == {"a": 3, "b": 5, "c": 6}
    assert B.read_checkpoint(spark, path) is not None


def test_lookup(spark):
    snap = spark.createDataFrame([("a", 1.5, at(1)), ("old", 2.5, dt.datetime(2000, 1, 1, tzinfo=UTC))],
                                 "loan_id string, dti_eff double, ts timestamp")
    refs = ["loan_features:dti_eff"]
    out = B.with_presence(B.lookup(spark, ["a", "b", "old"], snap, "loan_id", refs=refs, ts="ts", asof=at(2)), "loan_id")
    assert {r["loan_id"]: (r["dti_eff"], r["is_present"]) for r in out.collect()} == {
        "a": (1.5, True), "b": (None, False), "old": (None, False)}
    with pytest.raises(ValueError):
        B.lookup(spark, [], snap, "loan_id")
    with pytest.raises(ValueError, match="unknown"):
        B.resolve_refs(["loan_features:nope"])
    assert len(B.resolve_refs()) == 30


def test_stream_matches_batch(spark, tmp_path):
    src, table, log = (str(tmp_path / n) for n in ("src", "table", "log"))
    schema = "k string, ts timestamp, v int"
    rows(spark, ("a", 1, 1), ("b", 4, 4)).coalesce(1).write.mode("append").parquet(src)
    stream_snapshot(read_stream(spark, src, schema, max_files=1), table, "k", "ts", log).awaitTermination()
    rows(spark, ("a", 3, 3), ("b", 2, 2)).coalesce(1).write.mode("append").parquet(src)
    stream_snapshot(read_stream(spark, src, schema, max_files=1), table, "k", "ts", log).awaitTermination()
    assert {r["k"]: r["v"] for r in latest_version(spark, table).collect()} == {"a": 3, "b": 4}
    out, log2 = str(tmp_path / "up"), str(tmp_path / "log2")
    stream_upsert(read_stream(spark, src, schema), out, ["k"], ["v"], log2, order_col="ts").awaitTermination()
    assert {r["k"]: r["v"] for r in latest_version(spark, out).collect()} == {"a": 3, "b": 4}


def test_drift_tables_and_dashboard(spark, tmp_path):
    root = str(tmp_path)
    report = spark.createDataFrame([("int_rate", .4, .3, True), ("dti_eff", .05, .1, False)],
                                   "feature string, psi double, ks_statistic double, drifted boolean")
    P.append_drift(root, D.detect_drift(spark.range(5).select(F.col("id").alias("x")),
                                        spark.range(5).select(F.col("id").alias("x")), ["x"]), at(1))
    P.append_drift(root, report, at(2))
    runs, feats = spark.read.parquet(f"{root}/drift_runs"), spark.read.parquet(f"{root}/feature_drift")
    assert runs.count() == 2 and feats.count() == 3
    assert P.latest_drift_status(runs).first()["status"] == 1 and P.latest_n_drifted(runs).first()[0] == 1
    assert [r["feature"] for r in P.latest_features(feats, "psi").collect()] == ["int_rate", "dti_eff"]
    assert [r["feature"] for r in P.drift_alerts(feats).collect()] == ["int_rate"]


LOAN_DDL = S.ddl([f for f in S.RAW_LOAN_FIELDS if f[0] != "loaded_at"])


def write_inputs(spark, sf_dir, root):
    """CSV of one line per loan, and series Parquet, from the test tables."""
    from riskframe.operators.upsert import dedup_latest
    from riskframe.plans import adapters as A
    loans = dedup_latest(A.loads(spark, sf_dir), ["loan_id"], ["loaded_at"], A.LOAD_TIEBREAK)
    text = {S.CSV_RENAMES.get(n, n): (F.date_format(n, S.CSV_DATE_FORMAT) if k == "date" else F.col(n).cast("string"))
            for n, k in S.RAW_LOAN_FIELDS if n != "loaded_at"}
    loans.where("loan_amnt > 0 and annual_inc >= 0").select(*[c.alias(n) for n, c in text.items()]).write.option(
        "header", True).csv(f"{root}/in/loans")
    series = A.series(spark, sf_dir).groupBy("series_id", "observation_date").agg(F.max("value").cast("double").alias("value"))
    series.write.parquet(f"{root}/in/series")
    return f"{root}/in/loans", f"{root}/in/series"


def test_jobs_end_to_end(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    loans, series = write_inputs(spark, sf_dir, root)
    final = jobs.etl(spark, root, now=dt.datetime(2010, 1, 1, tzinfo=UTC), loans_csv=loans, series_path=series)
    n = final.count()
    assert n > 500 and final.where("unemployment_rate is not null").count() > 0
    assert latest_version(spark, f"{root}/snapshot").count() == n
    # a second identical load changes nothing
    again = jobs.etl(spark, root, now=dt.datetime(2010, 1, 2, tzinfo=UTC), loans_csv=loans, series_path=series)
    assert again.count() == n
    assert isinstance(jobs.run_drift_check(spark, root, "1999-12-31", ["loan_amnt", "int_rate"]), bool)
    out = jobs.retrain(spark, root, "logistic_regression", "1999-12-31")
    assert out["passes_gate"] in (True, False) and out["metrics"]["pr_auc"] > 0
    bins = spark.read.parquet(f"{root}/monitoring/prediction_bins")
    assert bins.count() == 20
    runs = spark.read.parquet(f"{root}/monitoring/runs").first()
    assert "cm_tp" in runs["metrics"] and runs["params"]["cutoff"] == "1999-12-31"
    # the gate stops a broken mart before it is published
    dup = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(Q.QualityError):
        Q.assert_quality(Q.quality_summary(dup, Q.not_null(["id"]), [["id"]]))
