"""Named queries over the order / line-item tables, one per operator family member.

Every query reads its whole tables; ``oracles`` holds the same results as plain SQL where SQL can
express them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta
from functools import reduce, wraps

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions import scalar as X
from riskframe.operators import asof as AT
from riskframe.operators import boosting as H
from riskframe.operators import drift as D
from riskframe.operators import explain as E
from riskframe.operators import fairness as FA
from riskframe.operators import metrics as M
from riskframe.operators import models as ML
from riskframe.operators import monitor as P
from riskframe.operators import ordered as O
from riskframe.operators import prep as T
from riskframe.operators import quality as Q
from riskframe.operators import snapshot as B
from riskframe.operators import survival as V
from riskframe.operators import timeseries as W
from riskframe.operators.upsert import dedup_latest, upsert
from riskframe.plans import adapters as A
from riskframe.plans import mart, rules
from riskframe.session import cut_lineage, ensure_checkpoint_dir, shuffles_removed, split_huge_methods
from riskframe.sources import files as SRC
from riskframe.sources.commits import AppendTable, BucketTable
from riskframe.sources.tables import latest_version
from riskframe.streaming.incremental import read_stream, stream_bucket_snapshot, stream_snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUTOFF = "1999-12-31"
MART_CHECKED = ["id", "installment_to_income_ratio", "is_default"]
UPSERT_SPLIT = "1998-07-01"
SNAPSHOT_WINDOW = (datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def query(fn: Query) -> Query:
    """Registers a query; it runs under the library's method limit in any session."""
    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        split_huge_methods(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


# ---- shared stages ----------------------------------------------------------------------------

def _staging(spark: SparkSession, d: str) -> DataFrame:
    return mart.loans_staging(A.loads(spark, d), A.LOAD_TIEBREAK)


def _macro(spark: SparkSession, d: str) -> DataFrame:
    return mart.macro_staging(A.series(spark, d), ["value"])


def _final(spark: SparkSession, d: str) -> DataFrame:
    return mart.final_features(mart.loan_features(_staging(spark, d)), mart.macro_features(_macro(spark, d)))


def _mart(spark: SparkSession, d: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """The mart's named columns as a written table, for queries that read them more than once."""
    return cut_lineage(_final(spark, d).select(*columns))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return M.score_curve(A.scored(spark, d))


def _survival(spark: SparkSession, d: str) -> DataFrame:
    return V.derive_survival(A.survival_input(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = A.scored(spark, d)
    limit = F.lit(A.DRIFT_CUTOFF).cast("date")
    return df.where(F.col("shipped") <= limit), df.where(F.col("shipped") > limit)


# ---- mart -------------------------------------------------------------------------------------

@query
def default_rate_by_month(spark, d):
    return A.rounded(P.rate_by_month(_final(spark, d)))


@query
def loans_staging(spark, d):
    return A.plain(_staging(spark, d))


@query
def loan_features(spark, d):
    return A.rounded(mart.loan_features(_staging(spark, d)))


@query
def macro_staging(spark, d):
    return A.rounded(_macro(spark, d))


@query
def macro_features(spark, d):
    return A.rounded(mart.macro_features(_macro(spark, d)))


@query
def macro_features_calendar(spark, d):
    """Lags by calendar month on the gap-filled, forward-filled table."""
    return A.rounded(mart.macro_features(mart.macro_staging(A.series(spark, d), ["value"], fill="forward"), calendar=True))


@query
def final_features(spark, d):
    return A.rounded(_final(spark, d))


# ---- sources ----------------------------------------------------------------------------------

def _loads_text(spark: SparkSession, d: str, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    raw = A.loads(spark, d, turn)
    text = {S.CSV_RENAMES.get(n, n): (F.date_format(n, S.CSV_DATE_FORMAT) if k == "date" else F.col(n).cast("string"))
            for n, k in S.RAW_LOAN_FIELDS if n != "loaded_at"}
    return raw.select(*[c.alias(n) for n, c in text.items()])


@query
def clean_loans(spark, d):
    """CSV text of the loads, typed again."""
    return A.plain(SRC.clean_loans(_loads_text(spark, d)))


# shares the CSV is written in: only one share's shuffle files are there at a time
CSV_TURNS = 4
# text takes a fifth of its size; such a file is read by one task, so none gets too many rows
CSV_PACKING = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 250_000}


@query
def csv_loans(spark, d):
    """Loads written as CSV in another column order beside unknown columns, read by header name."""
    note = F.concat(F.lit('of "'), "id", F.lit('", as filed'))
    path = f"{ensure_checkpoint_dir(spark)}/loads-{uuid.uuid4().hex}"
    for turn in range(CSV_TURNS):
        text = _loads_text(spark, d, (turn, CSV_TURNS))
        names = sorted(text.columns, reverse=True)
        with shuffles_removed(spark):
            text.select(*names[:5], note.alias("note"), *names[5:], F.lit("").alias("url")).write.mode("append").options(
                header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_PACKING).csv(path)
    return A.plain(SRC.clean_loans(SRC.read_csv(spark, path)))


@query
def read_series(spark, d):
    return A.plain(SRC.read_series(A.series(spark, d)))


def _frames(spark: SparkSession, d: str, tag: str, value: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    fact = F.struct(F.concat(F.lit("a-"), F.col("o_orderkey")).alias("accn"), F.col("o_custkey").alias("cik"),
                    F.col("o_orderpriority").alias("entityName"), F.lit("US").alias("loc"),
                    F.col("o_orderdate").cast("date").cast("string").alias("end"), F.col(value).alias("val"))
    return o.select(F.to_json(F.struct(F.array(fact).alias("data"))).alias("payload"),
                    F.lit(tag).alias("tag"), F.lit(S.FILING_TAGS[tag]).alias("uom"))


@query
def flatten_filings(spark, d):
    """Nested JSON frames of every tag, flattened and stacked."""
    parts = [SRC.flatten_frames(_frames(spark, d, tag, "o_custkey" if tag == "Revenues" else "o_totalprice"))
             for tag in S.FILING_TAGS]
    return A.plain(SRC.union_frames(parts))


@query
def json_flatten(spark, d):
    """Typed value out of the events' JSON text."""
    ev = A.table(spark, d, "events").withColumn("p", F.from_json("props", "struct<k:int>"))
    return ev.select("event_id", F.col("p.k").alias("k"))


# ---- expressions ------------------------------------------------------------------------------

@query
def text_cleaning(spark, d):
    df = A.loads(spark, d)
    return df.select("loan_id", X.trimmed("term").alias("term"), X.digits("term").alias("term_digits"),
                     X.digits_int("term").alias("term_months"), X.blank_to_null("emp_title").alias("emp_title"),
                     X.digits_int("emp_length").alias("emp_digits"), X.emp_years("emp_length").alias("emp_years"))


@query
def date_parts(spark, d):
    df = A.loads(spark, d)
    a, b = F.col("issue_date"), F.col("earliest_cr_line")
    return A.plain(df.select("loan_id", X.year_of(a).alias("y"), X.month_of(a).alias("m"),
                             X.month_start(a).alias("month"), X.age_years(a, b).alias("age_years"),
                             X.month_diff(a, b).alias("month_diff")))


@query
def guarded_ratios(spark, d):
    df = A.loads(spark, d)
    return A.rounded(df.select(
        "loan_id", X.guarded_ratio(F.col("installment") * 12, "annual_inc").alias("ratio"),
        X.pct_to_frac("revol_util").alias("util"), X.or_zero("dti").alias("dti_eff"),
        X.flag_positive("pub_rec").alias("has_public_record"), X.clip("dti", 1.0, 30.0).alias("dti_clipped")))


@query
def null_defaults(spark, d):
    cols = ["loan_id", "dti", "delinq_2yrs", "pub_rec", "revol_util", "recoveries"]
    return A.plain(X.fill_zero(A.loads(spark, d).select(*cols), cols[1:]))


@query
def number_coercion(spark, d):
    df = A.loads(spark, d)
    return df.select("loan_id", X.to_number("zip_code").alias("zip_number"),
                     X.to_number(F.substring("sub_grade", 2, 1)).alias("grade_number"))


@query
def target_labels(spark, d):
    df = A.loads(spark, d)
    return df.select("loan_id", X.binary_target("loan_status", S.DEFAULT_STATUSES, S.PAID_STATUSES).alias("is_default"),
                     X.binarize("home_ownership", ["MORTGAGE", "OWN"]).alias("privileged"))


@query
def decision_table(spark, d):
    """Score, tier and approval per line item, with given ids."""
    df = A.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ref"), F.expr(A.SCORED["score"]).alias("score"))
    return A.rounded(ML.decide(df, "score", "ref"))


@query
def value_differences(spark, d):
    li = A.table(spark, d, "lineitem")
    price, other = F.col("l_extendedprice"), F.floor("l_extendedprice").cast("double")
    out = li.select("l_orderkey", "l_partkey", X.differs(price, other).alias("differs"),
                    X.differs("l_returnflag", "l_linestatus").alias("text_differs"),
                    X.format_value(price).alias("shown"), X.format_value(F.col("l_quantity")).alias("shown_quantity"),
                    X.direction(price - 50000).alias("direction"))
    return A.plain(out)


# ---- dedup, upsert, series --------------------------------------------------------------------

@query
def latest_load_per_member(spark, d):
    df = A.loads(spark, d).select("member_id", "loan_id", *A.LOAD_TIEBREAK, "loaded_at")
    return A.plain(dedup_latest(df, ["member_id"], ["loaded_at"], [*A.LOAD_TIEBREAK, "loan_id"]))


UPSERT_COLS = ["loan_id", "loan_amnt", "term", "int_rate", "loan_status", "total_pymnt", "last_pymnt_date", "loaded_at"]


@query
def partial_upsert(spark, d):
    """Loads before a date form the table, later ones arrive in order."""
    raw = A.loads(spark, d).withColumn("seq", F.struct("loaded_at", *A.LOAD_TIEBREAK))
    split = F.lit(UPSERT_SPLIT).cast("timestamp")
    base = dedup_latest(raw.where(F.col("loaded_at") < split), ["loan_id"], ["loaded_at"], A.LOAD_TIEBREAK)
    incoming = raw.where(F.col("loaded_at") >= split)
    now = F.lit("2020-01-01").cast("timestamp")
    out = upsert(base.select(*UPSERT_COLS), incoming, ["loan_id"], S.LOAN_UPDATE_COLS, "seq", now=now)
    return A.plain(out)


@query
def bucketed_upsert(spark, d):
    """The same upsert on a bucketed table, whose later loads arrive as two runs, the first delivered twice."""
    raw = A.loads(spark, d).withColumn("seq", F.struct("loaded_at", *A.LOAD_TIEBREAK))
    split, later = (F.lit(t).cast("timestamp") for t in (UPSERT_SPLIT, "1998-10-01"))
    base = dedup_latest(raw.where(F.col("loaded_at") < split), ["loan_id"], ["loaded_at"], A.LOAD_TIEBREAK)
    table = BucketTable(spark, _scratch(spark, "loans"), ["loan_id"])
    table.merge(base.select(*UPSERT_COLS), lambda old, batch: batch, "base")
    now = F.lit("2020-01-01").cast("timestamp")
    runs = {"a": raw.where((F.col("loaded_at") >= split) & (F.col("loaded_at") < later)), "b": raw.where(F.col("loaded_at") >= later)}
    for run in ("a", "b", "a"):
        table.upsert(runs[run], S.LOAN_UPDATE_COLS, "seq", now=now, run_id=run)
    return A.plain(table.read())


@query
def series_upsert(spark, d):
    """Value-only upsert on (series, date)."""
    rows = A.series(spark, d).groupBy("series_id", "observation_date")
    base = rows.agg(F.min("value").alias("value")).where(F.dayofmonth("observation_date") <= 20)
    incoming = rows.agg(F.max("value").alias("value")).where(F.dayofmonth("observation_date") >= 10)
    out = upsert(base, incoming, ["series_id", "observation_date"], ["value"], ts_col=None)
    return A.plain(out)


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    monthly = A.series(spark, d).withColumn("month", X.month_start("observation_date"))
    return dedup_latest(monthly, ["series_id", "month"], ["observation_date"], ["value"])


@query
def last_per_month(spark, d):
    return A.plain(_monthly(spark, d))


@query
def pivot_series(spark, d):
    df = A.series(spark, d).withColumn("month", X.month_start("observation_date"))
    return A.plain(W.pivot_series(df, "month", "series_id", "value", S.SERIES_COLUMNS))


@query
def lag_diff(spark, d):
    df = _monthly(spark, d).select("series_id", "month", F.col("value").cast("double").alias("value"))
    return A.rounded(W.lag_diff(df, "month", "value", 12, "yoy_change", partition=["series_id"]))


@query
def lag_growth(spark, d):
    df = _monthly(spark, d).select("series_id", "month", "value")
    return A.rounded(W.lag_growth(df, "month", "value", 1, "growth", partition=["series_id"]))


@query
def series_lags(spark, d):
    df = _monthly(spark, d).select("series_id", "month", "value")
    return A.plain(W.add_lags(df, "month", {"lag3": ("value", 3), "lag6": ("value", 6)}, partition=["series_id"]))


# ---- quality ----------------------------------------------------------------------------------

def _loan_rules() -> dict:
    return {**Q.not_null(["loan_id", "dti", "home_ownership", "loan_status"]),
            **Q.accepted_values("loan_status", S.LOAN_STATUSES[:3]), **Q.row_checks(S.RAW_LOAN_CHECKS)}


@query
def quality_summary(spark, d):
    return A.plain(Q.quality_summary(A.loads(spark, d), _loan_rules(), [["loan_id"], ["loan_id", "loaded_at"]]))


@query
def quality_violations(spark, d):
    return Q.quality_violations(A.loads(spark, d), _loan_rules(), "loan_id")


@query
def unique_violations(spark, d):
    return Q.unique_violations(A.loads(spark, d), ["loan_id"])


@query
def applicant_contract(spark, d):
    return A.plain(Q.row_rule_summary(A.loads(spark, d), Q.row_checks(S.APPLICANT_CHECKS)))


@query
def mart_quality(spark, d):
    rules = {**Q.not_null(["id", "installment_to_income_ratio"]), **Q.accepted_values("is_default", [0, 1])}
    return A.plain(Q.quality_summary(_mart(spark, d, MART_CHECKED), rules, [["id"]]))


def _checked(parts: dict[str, DataFrame]) -> DataFrame:
    return A.plain(reduce(DataFrame.unionByName, [rules.summary(df, table) for table, df in parts.items()]))


@query
def source_quality(spark, d):
    return _checked({"raw_loans": A.loads(spark, d), "raw_series": A.series(spark, d)})


@query
def staging_quality(spark, d):
    return _checked({"staging_loans": _staging(spark, d), "staging_macro": _macro(spark, d)})


@query
def macro_quality(spark, d):
    return _checked({"macro_features": mart.macro_features(_macro(spark, d))})


# ---- preparation ------------------------------------------------------------------------------

@query
def temporal_split_counts(spark, d):
    train, test = T.temporal_split(_final(spark, d).select("issue_d", "is_default"), cutoff=CUTOFF)
    parts = [p.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"), F.sum("is_default").alias("n_default"))
             for name, p in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query
def median_impute(spark, d):
    return A.rounded(T.medians(_mart(spark, d, S.NUMERICAL_FEATURES), S.NUMERICAL_FEATURES))


@query
def imputed_features(spark, d):
    df = _mart(spark, d, ["id", *S.NUMERICAL_FEATURES])
    return A.rounded(T.fit_imputer(df, df.columns[1:]).apply(df))


@query
def category_codes(spark, d):
    return T.category_codes(_mart(spark, d, S.CATEGORICAL_FEATURES), S.CATEGORICAL_FEATURES)


@query
def encoded_features(spark, d):
    df = _mart(spark, d, ["id", *S.CATEGORICAL_FEATURES])
    return T.fit_codes(df).apply(df)


@query
def exact_quantiles(spark, d):
    counts = T.value_counts(A.scored(spark, d), A.DRIFT_FEATURES)
    q = O.exact_quantiles(counts, "value", "n", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], by=["feature"])
    return A.rounded(q.select("feature", "n", F.posexplode("quantiles").alias("i", "q")))


# ---- snapshot ---------------------------------------------------------------------------------

def _events(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id",
                                              "event_type", "value")


@query
def snapshot_latest(spark, d):
    start, end = SNAPSHOT_WINDOW
    return B.materialize(_events(spark, d), "user_id", "ts", start, end, ["event_id"]).drop("ts")


@query
def snapshot_incremental(spark, d):
    """Snapshot up to a day, then the newer rows merged in."""
    ev, (start, end) = _events(spark, d), SNAPSHOT_WINDOW
    first = B.materialize(ev, "user_id", "ts", datetime(2023, 1, 1, tzinfo=UTC), start, ["event_id"])
    fresh = ev.where((F.col("ts") > F.lit(start)) & (F.col("ts") <= F.lit(end)))
    return B.merge_latest(first, fresh, "user_id", "ts", ["event_id"]).drop("ts")


@query
def snapshot_stream(spark, d):
    """The snapshot kept by a file stream with a merge per micro-batch."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = A.table(spark, d, "events").schema
    rows = read_stream(spark, d, schema, options={"pathGlobFilter": "events.parquet"})
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    stream_snapshot(rows, f"{root}/table", "user_id", "ts", f"{root}/progress", ["event_id"]).awaitTermination()
    return latest_version(spark, f"{root}/table").drop("ts")


@query
def bucketed_snapshot(spark, d):
    """The snapshot stream into a bucketed table, delivered twice; a repeated epoch changes nothing."""
    root, schema = _scratch(spark, "stream"), A.table(spark, d, "events").schema
    table = BucketTable(spark, f"{root}/table", ["user_id"])
    for again in ("first", "second"):
        rows = read_stream(spark, d, schema, options={"pathGlobFilter": "events.parquet"})
        rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
        rows = rows.where("user_id is not null and ts is not null")
        stream_bucket_snapshot(rows, table, "ts", "events", f"{root}/{again}", ["event_id"]).awaitTermination()
    return table.read().drop("ts")


@query
def feature_asof(spark, d):
    """Each purchase with its user's last other event at or before it, if not older than twelve hours."""
    ev = _events(spark, d)
    requests = ev.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("asked_at"))
    history = ev.where("event_type <> 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    found = AT.asof_join(requests, history, "user_id", "asked_at", "ts", ["last_event", "last_type", "last_value"], ["last_event"],
                         timedelta(hours=12))
    return found.select("event_id", "user_id", F.col("last_event").cast("double").alias("last_event"), "last_type", "last_value")


@query
def feature_lookup(spark, d):
    """Features of every customer key as the requested id; most are not loan ids."""
    snap = _final(spark, d)
    ids = A.table(spark, d, "part").select((F.col("p_partkey") * 3).alias("id"))
    refs = ["loan_features:loan_amnt", "loan_features:dti_eff", "loan_features:purpose", "macro_features:cpi"]
    found = B.get_features(ids, snap, "id", refs, ts="issue_d", asof=datetime(2007, 1, 1, tzinfo=UTC))
    return A.rounded(B.with_presence(found, "id"))


# ---- classification metrics -------------------------------------------------------------------

@query
def roc_auc(spark, d):
    return A.rounded(M.roc_auc(_curve(spark, d)))


@query
def pr_auc(spark, d):
    return A.rounded(M.pr_auc(_curve(spark, d)))


@query
def recall_at_precision(spark, d):
    return A.rounded(M.recall_at_precision(_curve(spark, d), 0.335, "recall"))


@query
def ks_by_label(spark, d):
    return A.rounded(M.ks_by_label(_curve(spark, d)))


@query
def best_threshold(spark, d):
    return A.rounded(M.best_threshold(_curve(spark, d)))


@query
def confusion(spark, d):
    return M.confusion(A.scored(spark, d), 0.5)


@query
def brier_ece(spark, d):
    return A.rounded(M.calibration(A.scored(spark, d)))


@query
def extended_metrics(spark, d):
    m = M.extended_metrics(A.scored(spark, d), score="fine_score")
    return A.rounded(m.select("*", "confusion_matrix.*").drop("confusion_matrix"))


@query
def flatten_metrics(spark, d):
    m = M.extended_metrics(A.scored(spark, d))
    return A.rounded(P.flatten_metrics(m))


@query
def metrics_gate(spark, d):
    return A.plain(M.passes_gate(M.pr_auc(_curve(spark, d)), 0.30))


@query
def score_histogram(spark, d):
    return A.rounded(M.score_histogram(A.scored(spark, d)))


@query
def calibration_curve(spark, d):
    return A.rounded(M.calibration_curve(A.scored(spark, d)))


@query
def roc_points(spark, d):
    """Every point; the origin's infinite threshold is shown as NULL."""
    points = M.roc_points(_curve(spark, d))
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return A.rounded(points.withColumn("threshold", finite), 9)


@query
def pr_points(spark, d):
    return A.rounded(M.pr_points(_curve(spark, d)), 9)


# ---- drift ------------------------------------------------------------------------------------

@query
def psi(spark, d):
    return A.rounded(D.psi(*_sides(spark, d), A.DRIFT_FEATURES))


@query
def ks_two_sample(spark, d):
    return A.rounded(D.ks_two_sample(*_sides(spark, d), A.DRIFT_FEATURES))


@query
def drift_report(spark, d):
    return A.rounded(D.detect_drift(*_sides(spark, d), [*A.DRIFT_FEATURES, "not_there"]))


@query
def drift_summary(spark, d):
    return A.rounded(D.drift_summary(D.detect_drift(*_sides(spark, d), A.DRIFT_FEATURES)))


@query
def drift_final_features(spark, d):
    """The monitoring job's check: all numeric mart features, train against test split."""
    train, test = T.temporal_split(_mart(spark, d, ["issue_d", "is_default", *S.NUMERICAL_FEATURES]), cutoff=CUTOFF)
    return A.rounded(D.detect_drift(train, test, S.NUMERICAL_FEATURES))


@query
def null_shares(spark, d):
    shared = ["unemployment_rate", "cpi_lag6", "loan_amnt"]
    train, test = T.temporal_split(_mart(spark, d, ["issue_d", "is_default", *shared]), cutoff=CUTOFF)
    return A.rounded(D.null_shares(train, test, shared))


# ---- fairness ---------------------------------------------------------------------------------

def _decided(spark: SparkSession, d: str) -> DataFrame:
    df = _final(spark, d).where("is_default is not null")
    share = (F.col("open_acc") + F.col("total_acc") + F.col("inq_last_6mths")) / F.lit(70.0)
    return df.withColumn("pred_default", X.label_at(share, ML.APPROVAL_THRESHOLD))


@query
def fairness_metrics(spark, d):
    return A.rounded(FA.fairness_metrics(_decided(spark, d), "is_default", "pred_default", S.PROTECTED_ATTRIBUTES))


@query
def fairness_audit(spark, d):
    return A.rounded(FA.audit(_decided(spark, d), "is_default", "pred_default", S.PROTECTED_ATTRIBUTES, "shares"))


# ---- monitoring -------------------------------------------------------------------------------

def _feature_drift(spark: SparkSession, d: str) -> DataFrame:
    """Monthly run rows derived from the line items."""
    li = A.table(spark, d, "lineitem")
    runs = li.groupBy(X.month_start("l_shipdate").alias("run_ts"),
                      F.concat("l_returnflag", "l_linestatus").alias("feature"))
    return runs.agg((F.avg("l_discount") * 5).alias("psi"), (F.avg("l_tax") * 5).alias("ks_statistic")
                    ).withColumn("drifted", F.col("psi") >= D.PSI_THRESHOLD)


def _drift_runs(spark: SparkSession, d: str) -> DataFrame:
    return _feature_drift(spark, d).groupBy("run_ts").agg(
        F.bool_or("drifted").alias("dataset_drift"), F.count_if("drifted").alias("n_drifted"),
        F.count(F.lit(1)).alias("n_features"))


def _model_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = A.table(spark, d, "lineitem")
    return li.groupBy(X.month_start("l_shipdate").alias("run_ts")).agg(
        (F.avg("l_discount") * 10).alias("roc_auc"), (F.avg("l_tax") * 10).alias("pr_auc"),
        (F.avg("l_quantity") / 50).alias("ks_statistic"))


@query
def recent_count(spark, d):
    return P.recent_count(A.table(spark, d, "orders"), "o_orderdate", datetime(2001, 7, 1, tzinfo=UTC), 24)


@query
def latest_drift_status(spark, d):
    return P.latest_drift_status(_drift_runs(spark, d))


@query
def latest_n_drifted(spark, d):
    return P.latest_n_drifted(_drift_runs(spark, d))


@query
def latest_metric(spark, d):
    return A.rounded(P.latest_metric(_model_metrics(spark, d), "pr_auc"), 8)


@query
def latest_run_psi(spark, d):
    return A.rounded(P.latest_features(_feature_drift(spark, d), "psi"), 8)


@query
def latest_run_ks(spark, d):
    return A.rounded(P.latest_features(_feature_drift(spark, d), "ks_statistic"), 8)


@query
def latest_bins(spark, d):
    """Histogram rows of the newest run only."""
    li = A.table(spark, d, "lineitem").select(X.month_start("l_shipdate").alias("run_ts"),
                                              F.expr(A.SCORED["score"]).alias("score"))
    edges = F.array(*[F.lit(e) for e in X.unit_edges(20)])
    rows = li.groupBy("run_ts", X.bin_left_closed("score", 20).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return P.latest_bins(rows.withColumn("bin_lo", F.get(edges, F.col("bin"))))


@query
def metric_trend(spark, d):
    return A.rounded(P.metric_trend(_model_metrics(spark, d)), 8)


@query
def appended_metrics(spark, d):
    """Metric rows appended as two runs, one of them delivered twice, and read back."""
    rows = cut_lineage(_model_metrics(spark, d))
    table = AppendTable(spark, _scratch(spark, "metrics"))
    old = F.col("run_ts") < F.lit("1996-01-01").cast("timestamp")
    for run in ("old", "new", "old"):
        table.append(rows.where(old if run == "old" else ~old), run)
    return A.rounded(P.metric_trend(table.read()), 8)


@query
def drift_alerts(spark, d):
    return A.rounded(P.drift_alerts(_feature_drift(spark, d)), 8)


# ---- survival ---------------------------------------------------------------------------------

@query
def survival_frame(spark, d):
    return A.rounded(_survival(spark, d).select("issue_d", "term_months", "quantity", "event", "duration_months"))


@query
def kaplan_meier(spark, d):
    return A.rounded(V.kaplan_meier(_survival(spark, d)))


@query
def kaplan_meier_by_term(spark, d):
    df = _survival(spark, d).withColumn("grp", F.coalesce("term_months", F.lit(0)))
    return A.rounded(V.kaplan_meier(df, by=["grp"]))


@query
def censoring_curve(spark, d):
    return A.rounded(V.kaplan_meier(_survival(spark, d), of_censoring=True).select("t", "surv"))


@query
def concordance(spark, d):
    return A.rounded(V.concordance(_survival(spark, d)))


@query
def brier_scores(spark, d):
    return A.rounded(V.brier_scores(_survival(spark, d), A.HORIZONS))


@query
def integrated_brier(spark, d):
    return A.rounded(V.integrated_brier(_survival(spark, d), A.HORIZONS))


@query
def step_lookup(spark, d):
    """Survival at every tenth of the order price range, as of the last curve time."""
    curve = V.kaplan_meier(_survival(spark, d)).select("t", "surv")
    points = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000.0).alias("at"))
    return A.rounded(O.step_lookup(points, "at", curve, "t", "surv").select("o_orderkey", "surv"))


@query
def curve_area(spark, d):
    """Area under the Kaplan-Meier steps taken as a polyline."""
    return A.rounded(O.trapezoid(V.kaplan_meier(_survival(spark, d)), "t", "surv"))


# given coefficients, so that the prediction itself can be checked against SQL
GIVEN_BETA = {"quantity": (0.02, 25.0), "discount": (-3.0, 0.05)}


def _given_cox(spark: SparkSession, d: str) -> tuple[DataFrame, V.CoxModel]:
    """Survival rows and a model whose baseline hazard is taken from the Kaplan-Meier curve."""
    df = _survival(spark, d)
    baseline = cut_lineage(V.kaplan_meier(df).where("surv > 0").select("t", (-F.log("surv")).alias("h0")))
    betas = tuple(b for b, _ in GIVEN_BETA.values())
    means = tuple(m for _, m in GIVEN_BETA.values())
    return df, V.CoxModel(tuple(GIVEN_BETA), betas, means, 0.0, baseline, baseline.count())


@query
def given_survival_at(spark, d):
    df, m = _given_cox(spark, d)
    return A.rounded(V.survival_at(df, m, [12, 24, 36], keep=["issue_d", "quantity", "discount"]))


@query
def given_median_survival(spark, d):
    df, m = _given_cox(spark, d)
    out = V.median_survival(df, m, keep=["issue_d", "quantity", "discount"])
    return A.rounded(out.withColumn("median", F.when(F.col("median") < float("inf"), F.col("median"))))


@query
def given_survival_curves(spark, d):
    df, m = _given_cox(spark, d)
    rows = df.groupBy("quantity", "discount").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("id", F.concat_ws("/", F.col("quantity").cast("int"), F.round(F.col("discount") * 100).cast("int")))
    return A.rounded(V.predict_survival(rows, m, "id"))


# the stated grid of times of single curves
CURVE_TIMES = [12, 24, 36, 48, 60]


@query
def line_survival_curves(spark, d):
    """Each line item's own curve on a stated grid of times."""
    _, m = _given_cox(spark, d)
    # a curve needs no outcome: line items without one have theirs too
    lines = A.survival_input(spark, d, {"order_key": "l_orderkey", "line_number": "l_linenumber"})
    lines = lines.withColumn("id", F.struct("order_key", "line_number"))
    return A.rounded(V.predict_survival(lines, m, "id", CURVE_TIMES).select("id.*", "t", "surv"))


# ---- models (no SQL equivalent) ---------------------------------------------------------------

COX_FEATURES = ["quantity", "discount", "tax"]


def _cox(spark: SparkSession, d: str) -> tuple[DataFrame, V.CoxModel]:
    df = _survival(spark, d)
    return df, V.fit_cox(df, COX_FEATURES)


@query
def cox_fit(spark, d):
    _, m = _cox(spark, d)
    return spark.createDataFrame([(f, float(b), float(x)) for f, b, x in zip(m.features, m.beta, m.means)],
                                 "feature string, beta double, mean double")


@query
def cox_survival_at(spark, d):
    df, m = _cox(spark, d)
    return V.survival_at(df, m, [12, 24, 36], keep=["issue_d", "quantity"])


@query
def cox_median_survival(spark, d):
    df, m = _cox(spark, d)
    return V.median_survival(df, m, keep=["issue_d", "quantity"])


@query
def cox_curves(spark, d):
    df, m = _cox(spark, d)
    rows = df.withColumn("id", F.xxhash64("issue_d", "quantity", "discount", "tax", "duration_months"))
    return V.predict_survival(rows, m, "id", times=[6, 12, 24, 36])


MODEL_FEATURES = ["loan_amnt", "int_rate", "annual_inc", "dti_eff", "revol_bal", "open_acc", "total_acc"]


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    df = _mart(spark, d, ["id", "issue_d", "is_default", *MODEL_FEATURES]).where("is_default is not null")
    return df.select("id", "issue_d", *[F.col(f).cast("double").alias(f) for f in MODEL_FEATURES],
                     F.col("is_default").cast("double").alias("label"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features").transform(df)


@query
def logreg_scores(spark, d):
    rows = _assembled(_model_rows(spark, d))
    return ML.score(rows, ML.fit_logreg(rows), keep=["id"])


@query
def gbt_scores(spark, d):
    rows = _assembled(_model_rows(spark, d))
    return ML.score(rows, ML.fit_gbt(rows), keep=["id"])


@query
def hist_boost_scores(spark, d):
    """Second-order histogram boosting at its default size."""
    rows = cut_lineage(_model_rows(spark, d))
    return H.score_hist_boost(rows, H.fit_hist_boost(rows, MODEL_FEATURES), ["id"])


BOOST_CUTS = {"loan_amnt": [50_000.0, 120_000.0, 200_000.0], "dti_eff": [5.0, 15.0, 25.0], "annual_inc": [20_000.0, 60_000.0]}


@query
def hist_boost_tree(spark, d):
    """One tree of depth 2 over given cuts, from margin 0; NULLs take the side of the higher gain."""
    rows = _final(spark, d).where("is_default is not null").select(
        *[F.when(F.col("id") % 5 != i, F.col(f).cast("double")).alias(f) for i, f in enumerate(BOOST_CUTS)],
        F.col("is_default").cast("double").alias("label"))
    model = H.fit_hist_boost(cut_lineage(rows), list(BOOST_CUTS), n_trees=1, depth=2, rate=1.0,
                             cuts=list(BOOST_CUTS.values()), base_margin=0.0)
    side = F.when(F.col("missing_left"), "left").when(~F.col("missing_left"), "right")
    return A.rounded(H.describe_trees(model, spark).select(
        "node", "feature", "cut", side.alias("missing_side"), "gain", "value", "rows", "hessian"))


@query
def training_metrics(spark, d):
    """Split, fit, score and evaluate on the mart."""
    _, metrics = ML.run_training(_mart(spark, d), "logistic_regression", cutoff=CUTOFF)
    return A.plain(metrics.select("*", "confusion_matrix.*").drop("confusion_matrix"))


def _linear_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = _model_rows(spark, d)
    model = ML.fit_logreg(_assembled(rows))
    return E.linear_maps(rows, model, rows, MODEL_FEATURES, "id")


@query
def linear_attributions(spark, d):
    return E.long_form(_linear_maps(spark, d))


def _additivity(rows: DataFrame, maps: DataFrame, margin: Column) -> DataFrame:
    """Per row whether base value and attributions add up to the model's margin."""
    total = F.aggregate(F.map_values("attributions"), F.col("base_value"), lambda a, v: a + v)
    both = maps.select("id", total.alias("total")).join(rows.select("id", margin.alias("margin")), "id")
    return A.plain(both.select("id", (F.abs(F.col("total") - F.col("margin")) < 1e-9 * (1 + F.abs("margin"))).alias("adds_up")))


@query
def linear_additivity(spark, d):
    rows = _model_rows(spark, d)
    assembled = _assembled(rows)
    model = ML.fit_logreg(assembled)
    raw = model.transform(assembled).select("id", vector_to_array("rawPrediction").alias("raw"))
    return _additivity(raw, E.linear_maps(rows, model, rows, MODEL_FEATURES, "id"), F.col("raw")[1])


@query
def tree_additivity(spark, d):
    rows = _model_rows(spark, d)
    assembled = _assembled(rows)
    model = ML.fit_gbt(assembled)
    raw = model.transform(assembled).select("id", vector_to_array("rawPrediction").alias("raw"))
    return _additivity(raw, E.tree_maps(rows, model, MODEL_FEATURES, "id"), F.col("raw")[1])


@query
def hist_boost_additivity(spark, d):
    """Attributions of the boosted trees add up to the margin, missing values included."""
    rows = cut_lineage(_model_rows(spark, d).withColumn("dti_eff", F.when(F.col("id") % 3 != 0, F.col("dti_eff"))))
    model = H.fit_hist_boost(rows, MODEL_FEATURES)
    margins = H.score_hist_boost(rows, model, ["id"], margin="margin")
    return _additivity(margins, E.tree_maps(rows, model, MODEL_FEATURES, "id"), F.col("margin"))


@query
def top_attributions(spark, d):
    return E.top_attributions(_linear_maps(spark, d), 3)


@query
def global_importance(spark, d):
    return E.global_importance(E.long_form(_linear_maps(spark, d)))


@query
def attribution_records(spark, d):
    return E.attribution_records(_linear_maps(spark, d), "logistic_regression")


@query
def tree_attributions(spark, d):
    rows = _model_rows(spark, d)
    model = ML.fit_gbt(_assembled(rows))
    return E.attribute_trees(rows, model, MODEL_FEATURES, "id")


SCORECARD = {"loan_amnt": 0.00001, "int_rate": 0.15, "annual_inc": -0.00002, "dti_eff": 0.03, "open_acc": -0.01}


def _scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(_final(spark, d).select("id", *[F.col(f).cast("double").alias(f) for f in SCORECARD]))
    card = E.Scorecard(-2.0, DenseVector(list(SCORECARD.values())))
    return E.linear_maps(rows, card, rows, list(SCORECARD), "id")


@query
def scorecard_attributions(spark, d):
    return A.rounded(E.long_form(_scorecard(spark, d)))


@query
def scorecard_top(spark, d):
    return A.rounded(E.top_attributions(_scorecard(spark, d), 2).drop("base_value"))


@query
def scorecard_importance(spark, d):
    return A.rounded(E.global_importance(E.long_form(_scorecard(spark, d))))


@query
def scorecard_records(spark, d):
    """Attribution maps, read back entry by entry."""
    rec = E.attribution_records(_scorecard(spark, d), "scorecard")
    return A.rounded(rec.select("loan_id", "model_name", F.explode("attributions").alias("feature", "attribution")))


def _counterfactuals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _model_rows(spark, d)
    assembled = _assembled(rows)
    model = ML.fit_logreg(assembled)
    # loans above the overall default rate ask how to get below it
    base_rate = rows.agg(F.avg("label")).first()[0]
    declined = ML.score(assembled, model, keep=rows.columns).where(F.col("score") >= base_rate).drop("score")
    vary = ["loan_amnt", "int_rate", "dti_eff", "open_acc"]
    return declined, E.counterfactuals(declined, model, rows, MODEL_FEATURES, "id", vary=vary,
                                       threshold=base_rate)


@query
def counterfactuals(spark, d):
    return _counterfactuals(spark, d)[1]


@query
def change_report(spark, d):
    rows, cf = _counterfactuals(spark, d)
    return E.change_report(rows, cf, MODEL_FEATURES, "id")
