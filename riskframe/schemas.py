"""Table schemas, feature lists and rule lists (fixed values of the data model)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields])


RAW_LOAN_FIELDS: list[tuple[str, str]] = [
    ("loan_id", "bigint"), ("member_id", "bigint"), ("loan_amnt", "decimal(12,2)"),
    ("funded_amnt", "decimal(12,2)"), ("term", "string"), ("int_rate", "decimal(5,2)"),
    ("installment", "decimal(10,2)"), ("grade", "string"), ("sub_grade", "string"),
    ("emp_title", "string"), ("emp_length", "string"), ("home_ownership", "string"),
    ("annual_inc", "decimal(15,2)"), ("verification_status", "string"), ("issue_date", "date"),
    ("loan_status", "string"), ("purpose", "string"), ("title", "string"), ("zip_code", "string"),
    ("addr_state", "string"), ("dti", "decimal(8,2)"), ("delinq_2yrs", "int"),
    ("earliest_cr_line", "date"), ("inq_last_6mths", "int"), ("open_acc", "int"),
    ("pub_rec", "int"), ("revol_bal", "decimal(15,2)"), ("revol_util", "decimal(5,2)"),
    ("total_acc", "int"), ("total_pymnt", "decimal(15,2)"), ("total_rec_prncp", "decimal(15,2)"),
    ("total_rec_int", "decimal(15,2)"), ("recoveries", "decimal(15,2)"),
    ("collection_recovery_fee", "decimal(15,2)"), ("last_pymnt_date", "date"),
    ("last_pymnt_amnt", "decimal(15,2)"), ("application_type", "string"), ("loaded_at", "timestamp"),
]
SERIES_FIELDS = [
    ("series_id", "string"), ("observation_date", "date"), ("value", "decimal(15,4)"),
    ("series_name", "string"), ("loaded_at", "timestamp"),
]
FILING_FIELDS = [
    ("adsh", "string"), ("cik", "bigint"), ("company_name", "string"), ("form_type", "string"),
    ("period", "date"), ("fy", "int"), ("fp", "string"), ("tag", "string"),
    ("value", "decimal(24,4)"), ("uom", "string"), ("loaded_at", "timestamp"),
]
MODEL_METRIC_FIELDS = [
    ("run_ts", "timestamp"), ("model_name", "string"), ("roc_auc", "double"), ("pr_auc", "double"),
    ("ks_statistic", "double"), ("best_threshold", "double"), ("brier_score", "double"),
    ("ece", "double"),
]
DRIFT_RUN_FIELDS = [
    ("run_ts", "timestamp"), ("dataset_drift", "boolean"), ("drift_share", "double"),
    ("n_drifted", "int"), ("n_features", "int"),
]
FEATURE_DRIFT_FIELDS = [
    ("run_ts", "timestamp"), ("feature", "string"), ("psi", "double"),
    ("ks_statistic", "double"), ("drifted", "boolean"),
]
PREDICTION_BIN_FIELDS = [
    ("run_ts", "timestamp"), ("model_name", "string"), ("bin_lo", "double"),
    ("bin_hi", "double"), ("count", "bigint"),
]


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


# CSV header names that differ from the table column names
CSV_RENAMES = {"loan_id": "id", "issue_date": "issue_d", "last_pymnt_date": "last_pymnt_d"}
CSV_DATE_FORMAT = "MMM-yyyy"
CSV_REQUIRED = ["id", "loan_amnt", "issue_d"]
NULL_TO_ZERO = [
    "annual_inc", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal",
    "revol_util", "total_acc", "total_pymnt", "total_rec_prncp", "total_rec_int", "recoveries",
    "collection_recovery_fee", "last_pymnt_amnt",
]
LOAN_UPDATE_COLS = ["loan_status", "total_pymnt", "last_pymnt_date"]

SERIES_NAMES = {
    "FEDFUNDS": "Effective Federal Funds Rate",
    "UNRATE": "Civilian Unemployment Rate",
    "CPIAUCSL": "Consumer Price Index for All Urban Consumers",
    "GDPC1": "Real Gross Domestic Product",
}
SERIES_COLUMNS = {
    "FEDFUNDS": "fed_funds_rate", "UNRATE": "unemployment_rate", "CPIAUCSL": "cpi",
    "GDPC1": "real_gdp",
}
FILING_TAGS = {
    "NetIncomeLoss": "USD", "Revenues": "USD", "Assets": "USD", "Liabilities": "USD",
    "StockholdersEquity": "USD", "CashAndCashEquivalentsAtCarryingValue": "USD",
    "EarningsPerShareBasic": "USD/shares", "LongTermDebt": "USD",
}

DEFAULT_STATUSES = ["Charged Off", "Default", "Late (31-120 days)"]
PAID_STATUSES = ["Fully Paid"]
LOAN_STATUSES = ["Fully Paid", "Charged Off", "Current", "Default", "Late (31-120 days)",
                 "Late (16-30 days)"]
GRADES = list("ABCDEFG")
STAGING_ZERO = [
    "dti", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util",
    "total_acc", "total_pymnt", "total_rec_prncp", "total_rec_int", "recoveries",
]

LOAN_NUMERIC = [
    "loan_amnt", "term_months", "int_rate", "installment", "annual_inc", "dti_eff",
    "installment_to_income_ratio", "revol_bal", "revol_util_clean", "total_acc", "open_acc",
    "credit_history_age_months", "has_delinq", "has_public_record", "inq_last_6mths",
]
MACRO_FEATURES = [
    "unemployment_rate", "unrate_lag3", "unrate_lag6", "cpi", "cpi_lag3", "cpi_lag6",
    "fed_funds_rate", "fedfunds_lag3", "fedfunds_lag6",
]
NUMERICAL_FEATURES = LOAN_NUMERIC + MACRO_FEATURES
CATEGORICAL_FEATURES = ["home_ownership", "verification_status", "purpose", "addr_state", "grade",
                        "sub_grade"]
TARGET = "is_default"
SPLIT_DATE = "2017-12-31"

FEATURE_VIEWS = {
    "loan_features": LOAN_NUMERIC + CATEGORICAL_FEATURES,
    "macro_features": MACRO_FEATURES,
}
FEATURE_SERVICES = {"credit_scoring_v1": ["loan_features", "macro_features"]}
FEATURE_TTL_DAYS = 3650
ALL_FEATURE_REFS = [f"{view}:{col}" for view, cols in FEATURE_VIEWS.items() for col in cols]

# row checks: SQL text, NULL passes
RAW_LOAN_CHECKS = {
    "loan_amnt_positive": "loan_amnt > 0",
    "int_rate_range": "int_rate >= 0 AND int_rate <= 100",
    "annual_inc_not_negative": "annual_inc >= 0",
    "dti_not_negative": "dti >= 0",
}
SERIES_CHECKS = {"value_present": "value IS NOT NULL"}
APPLICANT_CHECKS = {
    "annual_inc_positive": "annual_inc > 0",
    "dti_not_negative": "dti >= 0",
    "delinq_2yrs_not_negative": "delinq_2yrs >= 0",
    "open_acc_not_negative": "open_acc >= 0",
    "revol_bal_not_negative": "revol_bal >= 0",
    "revol_util_range": "revol_util >= 0 AND revol_util <= 100",
    "total_acc_not_negative": "total_acc >= 0",
    "addr_state_length": "length(addr_state) = 2",
    "loan_amnt_positive": "loan_amnt > 0",
}
RAW_LOAN_NOT_NULL = ["loan_id", "loan_amnt", "issue_date", "loan_status"]
SERIES_NOT_NULL = ["series_id", "observation_date", "value"]
FILING_NOT_NULL = ["adsh", "tag", "period"]
PROTECTED_ATTRIBUTES = {"home_ownership": ["MORTGAGE", "OWN"], "addr_state": ["CA", "NY", "TX"]}
