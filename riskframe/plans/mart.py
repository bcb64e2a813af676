"""Raw to staging to mart: lazy DataFrame plans, one function per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions import scalar as X
from riskframe.operators.timeseries import (
    add_lags, forward_fill, join_context, lag_diff, lag_growth, month_spine, pivot_series,
)
from riskframe.operators.upsert import dedup_latest


def valid_loans(df: DataFrame) -> DataFrame:
    return df.where("loan_id is not null and loan_amnt > 0 and issue_date is not null")


def loans_staging(raw: DataFrame, tiebreak: Sequence[str | Column] = ()) -> DataFrame:
    """Latest load per loan, cleaned, with target, employment years and age columns.

    Rows without an outcome stay (the split drops them); the last payment date is carried along
    for survival durations.
    """
    latest = dedup_latest(valid_loans(raw), ["loan_id"], ["loaded_at"], tiebreak)
    changed = {
        "term": X.trimmed("term"),
        "emp_title": X.blank_to_null("emp_title"),
        "emp_length_years": X.emp_years("emp_length"),
        "issue_year": X.year_of("issue_date"),
        "issue_month": X.month_of("issue_date"),
        "is_default": X.binary_target("loan_status", S.DEFAULT_STATUSES, S.PAID_STATUSES),
        "credit_age_years": X.age_years("issue_date", "earliest_cr_line"),
        **{c: X.or_zero(c) for c in S.STAGING_ZERO},
    }
    keep = ["loan_id", "member_id", "loan_amnt", "funded_amnt", "term", "int_rate", "installment",
            "grade", "sub_grade", "emp_title", "emp_length", "emp_length_years", "home_ownership",
            "annual_inc", "verification_status", "issue_date", "issue_year", "issue_month",
            "loan_status", "is_default", "purpose", "addr_state", "dti", "delinq_2yrs",
            "earliest_cr_line", "credit_age_years", "inq_last_6mths", "open_acc", "pub_rec",
            "revol_bal", "revol_util", "total_acc", "total_pymnt", "total_rec_prncp",
            "total_rec_int", "recoveries", "last_pymnt_date", "application_type", "loaded_at"]
    return latest.select(*[changed.get(c, F.col(c)).alias(c) for c in keep])


def loan_features(staging: DataFrame) -> DataFrame:
    """Model-ready loan columns: renames, term in months, ratios, history length, flags."""
    keep = {"id": "loan_id", "member_id": "member_id", "loan_amnt": "loan_amnt"}
    keep2 = ["int_rate", "installment", "grade", "sub_grade", "emp_length_years", "home_ownership",
             "annual_inc", "verification_status"]
    keep3 = ["loan_status", "purpose", "addr_state", "dti", "delinq_2yrs", "earliest_cr_line",
             "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
             "is_default", "last_pymnt_date"]
    return staging.select(
        *[F.col(old).alias(new) for new, old in keep.items()],
        X.digits_int("term").alias("term_months"),
        *keep2,
        F.col("issue_date").alias("issue_d"),
        *keep3,
        X.or_zero("dti").alias("dti_eff"),
        X.guarded_ratio(F.col("installment") * 12, "annual_inc").alias("installment_to_income_ratio"),
        X.pct_to_frac("revol_util").alias("revol_util_clean"),
        X.month_diff("issue_date", "earliest_cr_line").alias("credit_history_age_months"),
        X.flag_positive("delinq_2yrs").alias("has_delinq"),
        X.flag_positive("pub_rec").alias("has_public_record"),
    )


def macro_staging(series: DataFrame, tiebreak: Sequence[str | Column] = (),
                  fill: str | None = None) -> DataFrame:
    """Monthly wide macro table: last observation per series and month, CPI change, GDP growth.

    ``fill="forward"`` carries quarterly GDP into the months without an observation.
    """
    known = series.where("value is not null").withColumn("observation_month", X.month_start("observation_date"))
    last = dedup_latest(known, ["series_id", "observation_month"], ["observation_date"], tiebreak)
    wide = pivot_series(last, "observation_month", "series_id", "value", S.SERIES_COLUMNS)
    if fill == "forward":
        wide = forward_fill(wide, "observation_month", ["real_gdp"])
    wide = lag_diff(wide, "observation_month", "cpi", 12, "cpi_yoy_change")
    wide = lag_growth(wide, "observation_month", "real_gdp", 1, "gdp_qoq_growth")
    return wide.select("observation_month", "fed_funds_rate", "unemployment_rate", "cpi",
                       "cpi_yoy_change", "real_gdp", "gdp_qoq_growth")


def macro_features(staging: DataFrame, calendar: bool = False) -> DataFrame:
    """Lags of 3 and 6 rows for three series; ``calendar`` makes rows equal months first."""
    base = month_spine(staging, "observation_month") if calendar else staging
    base = base.select(F.col("observation_month").alias("date"), "unemployment_rate", "cpi", "fed_funds_rate")
    return add_lags(base, "date", {
        "unrate_lag3": ("unemployment_rate", 3), "unrate_lag6": ("unemployment_rate", 6),
        "cpi_lag3": ("cpi", 3), "cpi_lag6": ("cpi", 6),
        "fedfunds_lag3": ("fed_funds_rate", 3), "fedfunds_lag6": ("fed_funds_rate", 6),
    })


def final_features(loans: DataFrame, macro: DataFrame) -> DataFrame:
    return join_context(loans, macro, "issue_d", "date", S.MACRO_FEATURES)
