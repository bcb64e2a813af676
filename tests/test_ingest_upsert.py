import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators import quality as Q
from riskframe.operators import timeseries as W
from riskframe.operators.upsert import dedup_latest, upsert
from riskframe.plans import mart
from riskframe.sources import files, tables

NAMES = [S.CSV_RENAMES.get(n, n) for n, _ in S.RAW_LOAN_FIELDS if n != "loaded_at"]
GOOD = {"id": "7", "member_id": "", "loan_amnt": "1000.0", "term": " 36 months", "int_rate": "13.56",
        "installment": "33.9", "grade": "C", "emp_length": "10+ years", "annual_inc": "", "issue_d": "Dec-2015",
        "loan_status": "Fully Paid", "dti": "-1", "earliest_cr_line": "Aug-2003", "open_acc": "5.0",
        "last_pymnt_d": "Jan-2019", "revol_util": ""}


def write_csv(path, rows):
    lines = [",".join(NAMES)] + [",".join(str(r.get(n, "")) for n in NAMES) for r in rows]
    path.write_text("\n".join(lines))
    return str(path)


def test_csv_cleaning_and_rejects(spark, tmp_path):
    rows = [GOOD, {**GOOD, "id": "8", "loan_amnt": ""}, {**GOOD, "id": "Total amount funded"}]
    text = files.read_csv(spark, write_csv(tmp_path / "a.csv", rows))
    got = files.clean_loans(text).collect()
    assert [r["loan_id"] for r in got] == [7]
    r = got[0]
    assert r["issue_date"] == dt.date(2015, 12, 1) and r["earliest_cr_line"] == dt.date(2003, 8, 1)
    assert r["last_pymnt_date"] == dt.date(2019, 1, 1) and r["term"] == " 36 months"
    assert r["dti"] is None and r["member_id"] is None
    assert r["annual_inc"] == 0 and r["revol_util"] == 0 and r["open_acc"] == 5 and float(r["int_rate"]) == 13.56
    bad = {r["reason"] for r in files.rejected_loans(text).collect()}
    assert bad == {"missing required field", "id is not a number"}


def test_series(spark):
    df = spark.createDataFrame(
        [("UNRATE", "2020-01-01", 3.5), ("UNRATE", "2020-02-01", float("nan")), ("GDPC1", "2020-01-01", None),
         ("XXX", "2020-01-01", 1.0)], "series_id string, observation_date string, value double")
    rows = files.read_series(df).collect()
    assert len(rows) == 1 and rows[0]["series_name"] == "Civilian Unemployment Rate"


def test_filing_frames(spark):
    one = {"data": [{"accn": "a1", "cik": 5, "entityName": "X", "loc": "US", "end": "2023-12-31", "val": 12.5},
                    {"accn": None, "cik": 6, "entityName": "Y", "loc": "US", "end": "2023-12-31", "val": 1},
                    {"accn": "a2", "cik": 7, "entityName": "Z", "loc": "US", "end": "bad", "val": 2}]}
    df = spark.createDataFrame([("Assets", "USD", json.dumps(one)), ("Revenues", "USD", '{"data": []}')],
                               "tag string, uom string, payload string")
    rows = files.flatten_frames(df).orderBy("adsh").collect()
    assert [(r["adsh"], r["period"], r["form_type"]) for r in rows] == [("a1", dt.date(2023, 12, 31), None), ("a2", None, None)]
    assert files.union_frames([], spark).count() == 0
    with pytest.raises(ValueError):
        files.union_frames([])


BASE = "k int, a string, b string, loaded_at timestamp"


def test_upsert_semantics(spark):
    base = spark.createDataFrame([(1, "a1", "b1", None), (2, "a2", "b2", None)], BASE)
    new = spark.createDataFrame([(2, "x", None, 1), (3, "first", "f", 1), (3, "second", "s", 2)],
                                "k int, a string, b string, seq int")
    now = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
    out = {r["k"]: r for r in upsert(base, new, ["k"], ["b"], "seq", now=now).collect()}
    assert (out[1]["a"], out[1]["b"], out[1]["loaded_at"]) == ("a1", "b1", None)
    assert (out[2]["a"], out[2]["b"]) == ("a2", None) and out[2]["loaded_at"] is not None
    assert (out[3]["a"], out[3]["b"]) == ("first", "s")
    with pytest.raises(ValueError, match="duplicate"):
        upsert(base, new, ["k"], ["b"], "seq", now=now, on_duplicate="error")


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "b")], "k int, a string, b string")
    assert tables.latest_version(spark, path) is None
    assert tables.upsert_table(spark, path, rows, ["k"], ["b"]) == 1
    again = spark.createDataFrame([(1, "z", "c"), (2, "y", "d")], "k int, a string, b string")
    assert tables.upsert_table(spark, path, again, ["k"], ["b"]) == 2
    first = {(r["k"], r["a"], r["b"]) for r in tables.latest_version(spark, path).collect()}
    assert first == {(1, "a", "c"), (2, "y", "d")}
    tables.upsert_table(spark, path, again, ["k"], ["b"])
    assert {(r["k"], r["a"], r["b"]) for r in tables.latest_version(spark, path).collect()} == first


def test_dedup_is_stable_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 1), (1, 2, 3), (2, None, 1)], "k int, ts int, v int")
    out = dedup_latest(df, ["k"], ["ts"], ["v"])
    assert {(r["k"], r["v"]) for r in out.collect()} == {(1, 3), (2, 1)}
    assert {(r["k"], r["v"]) for r in dedup_latest(out, ["k"], ["ts"], ["v"]).collect()} == {(1, 3), (2, 1)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 5, "A"), (1, -1, None), (None, None, "Z")], "k int, v int, g string")
    rules = {**Q.not_null(["k"]), **Q.accepted_values("g", ["A"]), **Q.row_checks({"v": "v >= 0"})}
    s = {r["rule"]: (r["n_rows"], r["n_failed"]) for r in Q.quality_summary(df, rules, [["k"]]).collect()}
    assert s == {"not_null_k": (3, 1), "accepted_g": (3, 1), "check_v": (3, 1), "unique_k": (3, 1)}
    assert Q.quality_violations(df, rules, "k").count() == 3
    with pytest.raises(Q.QualityError, match="unique_k: 1"):
        Q.assert_quality(Q.quality_summary(df, rules, [["k"]]))
    Q.assert_quality(Q.quality_summary(df.where("k = 1 and v > 0"), rules, [["k"]]))


def test_applicant_rules(spark):
    cols = "annual_inc double, dti double, delinq_2yrs int, open_acc int, revol_bal double, revol_util double, " \
           "total_acc int, addr_state string, loan_amnt double"
    ok = (85000.0, 12.3, 0, 10, 15000.0, 42.1, 22, "CA", 15000.0)
    df = spark.createDataFrame([ok, (-500.0, *ok[1:])], cols)
    failed = Q.row_rule_summary(df, Q.row_checks(S.APPLICANT_CHECKS)).where("n_failed > 0").collect()
    assert [r["rule"] for r in failed] == ["check_annual_inc_positive"]


def test_months(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, 1, 1), 1.0), (d(2020, 4, 1), 4.0)], "m date, v double")
    spine = W.month_spine(df, "m").orderBy("m").collect()
    assert [r["v"] for r in spine] == [1.0, None, None, 4.0]
    filled = W.forward_fill(W.month_spine(df, "m"), "m", ["v"]).orderBy("m").collect()
    assert [r["v"] for r in filled] == [1.0, 1.0, 1.0, 4.0]
    grown = W.lag_growth(df, "m", "v", 1, "g").orderBy("m").collect()
    assert [r["g"] for r in grown] == [None, 300.0]
    zero = spark.createDataFrame([(d(2020, 1, 1), 0.0), (d(2020, 2, 1), 4.0)], "m date, v double")
    assert W.lag_growth(zero, "m", "v", 1, "g").orderBy("m").collect()[1]["g"] is None


def test_ages(spark):
    from riskframe.functions.scalar import age_years, differs, format_value
    d = dt.date
    df = spark.createDataFrame([(d(2015, 2, 28), d(2012, 2, 29)), (d(2012, 2, 29), d(2015, 2, 28)), (d(2015, 1, 1), None)],
                               "a date, b date")
    assert [r[0] for r in df.select(age_years("a", "b")).collect()] == [2, -2, None]
    v = spark.createDataFrame([("35", "35.000000001"), ("35", "25"), ("RENT", "OWN")], "a string, b string")
    assert [r[0] for r in v.select(differs("a", "b")).collect()] == [False, True, True]
    n = spark.createDataFrame([(25.0,), (35.456,)], "x double")
    assert [r[0] for r in n.select(format_value("x")).collect()] == ["25", "35.46"]


def test_macro_join_keeps_all_loans_without_shuffling_them(spark):
    d = dt.date
    loans = spark.createDataFrame([(1, d(2020, 1, 15)), (2, d(2021, 1, 1)), (3, None)], "id int, issue_d date")
    macro = spark.createDataFrame([(d(2020, 1, 1), 5.0)], "date date, cpi double")
    out = W.join_context(loans, macro, "issue_d", "date", ["cpi"])
    assert {(r["id"], r["cpi"]) for r in out.collect()} == {(1, 5.0), (2, None), (3, None)}
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_staging_keeps_rows_without_outcome(spark):
    df = spark.createDataFrame([(1, 100, "Current"), (2, 0, "Fully Paid")], "loan_id bigint, amt int, loan_status string")
    cols = {n: F.lit(None).cast(k) for n, k in S.RAW_LOAN_FIELDS if n not in df.columns}
    raw = df.withColumns({**cols, "loan_amnt": F.col("amt").cast("decimal(12,2)"), "issue_date": F.lit("2020-01-01").cast("date")})
    rows = mart.loans_staging(raw).collect()
    assert [(r["loan_id"], r["is_default"], float(r["dti"])) for r in rows] == [(1, None, 0.0)]


def test_csv_by_header_quotes_and_broken_lines(spark, tmp_path):
    names = [S.CSV_RENAMES.get(n, n) for n, _ in S.RAW_LOAN_FIELDS if n != "loaded_at"]
    known = {**dict.fromkeys(names, ""), **dict.fromkeys(S.CSV_REQUIRED, "1"), "issue_d": "Jan-2015"}
    header = ["surplus", *reversed(names)]

    def line(**values):
        return ",".join('"' + {"surplus": "x, y", **known, **values}[n].replace('"', '""') + '"' for n in header)

    (tmp_path / "a.csv").write_text("\n".join([
        ",".join(header), line(id="7", emp_title='Chief "Big", Boss'), line(id="8") + ",999,999"]) + "\n")
    text = files.read_csv(spark, str(tmp_path / "a.csv"))
    got = files.clean_loans(text).select("loan_id", "emp_title").collect()
    assert [(r.loan_id, r.emp_title) for r in got] == [(7, 'Chief "Big", Boss')]
    rejected = files.rejected_loans(text)
    assert rejected.count() == 1 and [r.reason for r in rejected.collect()] == ["broken line"]


def test_csv_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(S.CSV_REQUIRED) + "\n" + ",".join("1" for _ in S.CSV_REQUIRED) + "\n")
    row = files.clean_loans(files.read_csv(spark, str(tmp_path / "a.csv"))).first()
    assert row.loan_id == 1 and row.emp_title is None
    (tmp_path / "b.csv").write_text("emp_title\nBoss\n")
    with pytest.raises(ValueError, match="header lacks"):
        files.read_csv(spark, str(tmp_path / "b.csv"))


def test_upsert_without_order_keeps_keys_unique(spark):
    base = spark.createDataFrame([(1, 10, None)], "k int, v int, loaded_at timestamp")
    new = spark.createDataFrame([(1, 20), (1, 30), (2, 5), (2, 4)], "k int, v int")
    got = upsert(base, new, ["k"], ["v"]).select("k", "v").collect()
    assert sorted(map(tuple, got)) == [(1, 30), (2, 5)]


def test_series_repeated_key_takes_the_last_row(spark, tmp_path):
    from riskframe.plans import jobs
    from riskframe.sources import tables
    name = next(iter(S.SERIES_NAMES))
    day = dt.date(2001, 1, 1)
    spark.createDataFrame([(name, day, 9.0), (name, day, 2.0)], "series_id string, observation_date date, value double"
                          ).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.ingest(spark, str(tmp_path), series_path=str(tmp_path / "in"))
    assert [float(r.value) for r in tables.latest_version(spark, f"{tmp_path}/raw/series").collect()] == [2.0]
