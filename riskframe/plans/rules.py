"""Data rules of the source, staging and mart tables, and their summary per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators import quality as Q


def table_rules(table: str) -> tuple[dict[str, Column], list[list[str]]]:
    """(row rules, unique keys) of a table."""
    outcome = {**Q.accepted_values("is_default", [0, 1])}
    match table:
        case "raw_loans":
            return {**Q.not_null(S.RAW_LOAN_NOT_NULL), **Q.row_checks(S.RAW_LOAN_CHECKS)}, [["loan_id"]]
        case "raw_series":
            return {**Q.not_null(S.SERIES_NOT_NULL), **Q.row_checks(S.SERIES_CHECKS)}, []
        case "raw_filings":
            return Q.not_null(S.FILING_NOT_NULL), []
        case "staging_loans":
            return Q.not_null(["loan_id"]), [["loan_id"]]
        case "staging_macro":
            return Q.not_null(["observation_month"]), [["observation_month"]]
        case "loan_features":
            return {**Q.not_null(["id", "installment_to_income_ratio"]), **outcome}, [["id"]]
        case "macro_features":
            return Q.not_null(["date"]), [["date"]]
        case "final_features":
            return {**Q.not_null(["id"]), **outcome}, [["id"]]
    raise ValueError(f"no rules for {table}")


def summary(df: DataFrame, table: str) -> DataFrame:
    """One row per rule: table_name, rule, n_rows, n_failed, passed."""
    row_rules, unique = table_rules(table)
    return Q.quality_summary(df, row_rules, unique).select(F.lit(table).alias("table_name"), "*")


def require(df: DataFrame, table: str) -> DataFrame:
    """``df`` when it keeps all its rules, else QualityError."""
    Q.assert_quality(summary(df, table).withColumn("rule", F.concat_ws(".", "table_name", "rule")))
    return df
