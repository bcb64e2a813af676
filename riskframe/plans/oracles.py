"""The named queries as plain ANSI SQL, for a side-by-side check in another engine."""

from __future__ import annotations

from riskframe import schemas as S
from riskframe.functions.scalar import unit_edges
from riskframe.plans import adapters as A

ORACLES: dict[str, str] = {}

CUTOFF = "1999-12-31"


def _cols(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in columns.items())


_TIE = ", ".join(f"{c} DESC NULLS LAST" for c in A.LOAD_TIEBREAK)

LOADS = f"""loads AS (
  SELECT {_cols(A.LOADS)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""
SERIES = f"series AS (SELECT {_cols(A.SERIES)} FROM orders)"
SCORED = f"scored AS (SELECT {_cols(A.SCORED)} FROM lineitem)"
SURVIVAL = f"""surv_in AS (SELECT {_cols(A.SURVIVAL)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
surv AS (
  SELECT *, is_default AS event,
    least(greatest(coalesce(date_diff('day', issue_d, last_pymnt_date) / 30.44, coalesce(term_months, 36.0)), 1.0),
          coalesce(term_months, 36.0)) AS duration_months
  FROM (SELECT issue_d, last_pymnt_date, CAST(term_months AS DOUBLE) AS term_months, is_default, quantity, tax,
               discount, score, surv_6, surv_12, surv_24 FROM surv_in WHERE is_default IS NOT NULL))"""

STAGING = f"""{LOADS},
staging AS (
  SELECT loan_id, member_id, loan_amnt, funded_amnt, trim(term) AS term, int_rate, installment, grade, sub_grade,
    nullif(trim(emp_title), '') AS emp_title, emp_length,
    CASE emp_length WHEN '10+ years' THEN 11 WHEN '< 1 year' THEN 0 WHEN '3 years' THEN 3 WHEN '1 year' THEN 1 END
      AS emp_length_years,
    home_ownership, annual_inc, verification_status, issue_date,
    year(issue_date) AS issue_year, month(issue_date) AS issue_month, loan_status,
    CASE WHEN loan_status IN ('Charged Off', 'Default', 'Late (31-120 days)') THEN 1
         WHEN loan_status = 'Fully Paid' THEN 0 END AS is_default,
    purpose, addr_state, coalesce(dti, 0) AS dti, coalesce(delinq_2yrs, 0) AS delinq_2yrs, earliest_cr_line,
    date_part('year', age(issue_date, earliest_cr_line)) AS credit_age_years,
    coalesce(inq_last_6mths, 0) AS inq_last_6mths, coalesce(open_acc, 0) AS open_acc, coalesce(pub_rec, 0) AS pub_rec,
    coalesce(revol_bal, 0) AS revol_bal, coalesce(revol_util, 0) AS revol_util, coalesce(total_acc, 0) AS total_acc,
    coalesce(total_pymnt, 0) AS total_pymnt, coalesce(total_rec_prncp, 0) AS total_rec_prncp,
    coalesce(total_rec_int, 0) AS total_rec_int, coalesce(recoveries, 0) AS recoveries, last_pymnt_date,
    application_type, loaded_at
  FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY loaded_at DESC NULLS LAST, {_TIE}) AS rn
        FROM loads WHERE loan_id IS NOT NULL AND loan_amnt > 0 AND issue_date IS NOT NULL) q
  WHERE rn = 1)"""

FEATURES = f"""{STAGING},
features AS (
  SELECT loan_id AS id, member_id, loan_amnt,
    CAST(nullif(regexp_replace(term, '[^0-9]', '', 'g'), '') AS INT) AS term_months,
    int_rate, installment, grade, sub_grade, emp_length_years, home_ownership, annual_inc, verification_status,
    issue_date AS issue_d, loan_status, purpose, addr_state, dti, delinq_2yrs, earliest_cr_line, inq_last_6mths,
    open_acc, pub_rec, revol_bal, revol_util, total_acc, is_default, last_pymnt_date, dti AS dti_eff,
    CASE WHEN annual_inc > 0 THEN CAST(installment AS DOUBLE) * 12 / CAST(annual_inc AS DOUBLE) ELSE 0.0 END
      AS installment_to_income_ratio,
    CAST(revol_util AS DOUBLE) / 100 AS revol_util_clean,
    coalesce((year(issue_date) - year(earliest_cr_line)) * 12 + month(issue_date) - month(earliest_cr_line), 0)
      AS credit_history_age_months,
    CASE WHEN delinq_2yrs > 0 THEN 1 ELSE 0 END AS has_delinq,
    CASE WHEN pub_rec > 0 THEN 1 ELSE 0 END AS has_public_record
  FROM staging)"""

MONTHLY = f"""{SERIES},
monthly AS (
  SELECT series_id, observation_date, value, month FROM (
    SELECT *, CAST(date_trunc('month', observation_date) AS DATE) AS month,
      row_number() OVER (PARTITION BY series_id, date_trunc('month', observation_date)
                         ORDER BY observation_date DESC, value DESC) AS rn
    FROM series) q
  WHERE rn = 1)"""
_PIVOT = ", ".join(f"max(CASE WHEN series_id = '{k}' THEN value END) AS {v}" for k, v in S.SERIES_COLUMNS.items())


def _macro(fill: bool = False) -> str:
    gdp = ("last_value(real_gdp IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)" if fill else "real_gdp")
    return f"""{MONTHLY},
wide0 AS (SELECT month, {_PIVOT} FROM monthly GROUP BY month),
wide AS (SELECT month, fed_funds_rate, unemployment_rate, cpi, {gdp} AS real_gdp FROM wide0),
macro AS (
  SELECT month AS observation_month, fed_funds_rate, unemployment_rate, cpi,
    cpi - lag(cpi, 12) OVER (ORDER BY month) AS cpi_yoy_change, real_gdp,
    round((CAST(real_gdp AS DOUBLE) - lag(real_gdp) OVER (ORDER BY month))
      / nullif(lag(real_gdp) OVER (ORDER BY month), 0) * 100, 4) AS gdp_qoq_growth
  FROM wide)"""


def _macro_lags(source: str = "macro", fill: bool = False) -> str:
    lag = lambda c, n: f"lag({c}, {n}) OVER (ORDER BY observation_month)"
    return f"""{_macro(fill)},
spine AS (
  SELECT m.observation_month, unemployment_rate, cpi, fed_funds_rate
  FROM (SELECT CAST(unnest(generate_series(min(observation_month), max(observation_month), INTERVAL 1 MONTH)) AS DATE)
          AS observation_month FROM macro) m
  LEFT JOIN macro USING (observation_month)),
macro_lags AS (
  SELECT observation_month AS date, unemployment_rate, cpi, fed_funds_rate,
    {lag('unemployment_rate', 3)} AS unrate_lag3, {lag('unemployment_rate', 6)} AS unrate_lag6,
    {lag('cpi', 3)} AS cpi_lag3, {lag('cpi', 6)} AS cpi_lag6,
    {lag('fed_funds_rate', 3)} AS fedfunds_lag3, {lag('fed_funds_rate', 6)} AS fedfunds_lag6
  FROM {source})"""


FINAL = f"""{FEATURES},
{_macro_lags()},
final AS (
  SELECT f.*, {", ".join(f"m.{c}" for c in S.MACRO_FEATURES)}
  FROM features f LEFT JOIN macro_lags m ON CAST(date_trunc('month', f.issue_d) AS DATE) = m.date)"""

_TEXT = {"issue_date", "earliest_cr_line", "last_pymnt_date", "loaded_at", "issue_d"}
_RAW_KINDS = dict(S.RAW_LOAN_FIELDS)


def _plain(names: list[str], doubles: set[str] = frozenset(), round_to: int | None = None) -> str:
    """Output columns: dates as text, decimals (and the named ones) as double."""
    out = []
    for n in names:
        if n in _TEXT:
            out.append(f"CAST({n} AS STRING) AS {n}")
        elif _RAW_KINDS.get(n, "").startswith("decimal") or n in doubles:
            out.append(f"round(CAST({n} AS DOUBLE), {round_to}) AS {n}" if round_to else f"CAST({n} AS DOUBLE) AS {n}")
        else:
            out.append(n)
    return ", ".join(out)


_STAGING_COLS = ["loan_id", "member_id", "loan_amnt", "funded_amnt", "term", "int_rate", "installment", "grade",
                 "sub_grade", "emp_title", "emp_length", "emp_length_years", "home_ownership", "annual_inc",
                 "verification_status", "issue_date", "issue_year", "issue_month", "loan_status", "is_default",
                 "purpose", "addr_state", "dti", "delinq_2yrs", "earliest_cr_line", "credit_age_years",
                 "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "total_pymnt",
                 "total_rec_prncp", "total_rec_int", "recoveries", "last_pymnt_date", "application_type", "loaded_at"]
_FEATURE_COLS = ["id", "member_id", "loan_amnt", "term_months", "int_rate", "installment", "grade", "sub_grade",
                 "emp_length_years", "home_ownership", "annual_inc", "verification_status", "issue_d", "loan_status",
                 "purpose", "addr_state", "dti", "delinq_2yrs", "earliest_cr_line", "inq_last_6mths", "open_acc",
                 "pub_rec", "revol_bal", "revol_util", "total_acc", "is_default", "last_pymnt_date", "dti_eff",
                 "installment_to_income_ratio", "revol_util_clean", "credit_history_age_months", "has_delinq",
                 "has_public_record"]
_RATIOS = {"dti_eff", "installment_to_income_ratio", "revol_util_clean"}
_MACRO_COLS = {"fed_funds_rate", "unemployment_rate", "cpi", "cpi_yoy_change", "real_gdp", "gdp_qoq_growth",
               *S.MACRO_FEATURES}

ORACLES["default_rate_by_month"] = f"""WITH {FINAL}
SELECT CAST(CAST(date_trunc('month', issue_d) AS DATE) AS STRING) AS time,
  round(avg(CAST(is_default AS DOUBLE)), 6) AS default_rate
FROM final WHERE is_default IS NOT NULL GROUP BY 1"""
ORACLES["loans_staging"] = f"WITH {STAGING} SELECT {_plain(_STAGING_COLS)} FROM staging"
ORACLES["loan_features"] = f"WITH {FEATURES} SELECT {_plain(_FEATURE_COLS, _RATIOS, 6)} FROM features"
ORACLES["macro_staging"] = f"""WITH {_macro()}
SELECT CAST(observation_month AS STRING) AS observation_month,
{_plain(["fed_funds_rate", "unemployment_rate", "cpi", "cpi_yoy_change", "real_gdp", "gdp_qoq_growth"], _MACRO_COLS, 6)}
FROM macro"""
_LAG_COLS = ["unemployment_rate", "cpi", "fed_funds_rate", "unrate_lag3", "unrate_lag6", "cpi_lag3", "cpi_lag6",
             "fedfunds_lag3", "fedfunds_lag6"]
ORACLES["macro_features"] = f"""WITH {_macro_lags()}
SELECT CAST(date AS STRING) AS date, {_plain(_LAG_COLS, _MACRO_COLS, 6)} FROM macro_lags"""
ORACLES["macro_features_calendar"] = f"""WITH {_macro_lags("spine", True)}
SELECT CAST(date AS STRING) AS date, {_plain(_LAG_COLS, _MACRO_COLS, 6)} FROM macro_lags"""
ORACLES["final_features"] = f"""WITH {FINAL}
SELECT {_plain(_FEATURE_COLS + S.MACRO_FEATURES, _RATIOS | _MACRO_COLS, 6)} FROM final"""

# ---- sources ----------------------------------------------------------------------------------

_clean = []
for _n, _k in S.RAW_LOAN_FIELDS:
    if _n == "loaded_at":
        continue
    _e = _n
    if _k == "date":
        _e = f"CAST(date_trunc('month', {_n}) AS DATE)"
    if _n in S.NULL_TO_ZERO:
        _e = f"coalesce({_e}, 0)"
    if _n == "dti":
        _e = "CASE WHEN dti >= 0 THEN dti END"
    _kind = "STRING" if _k == "date" else "DOUBLE" if _k.startswith("decimal") else None
    _clean.append(f"CAST({_e} AS {_kind}) AS {_n}" if _kind else f"{_e} AS {_n}")
ORACLES["clean_loans"] = f"WITH {LOADS} SELECT {', '.join(_clean)} FROM loads"

ORACLES["csv_loans"] = ORACLES["clean_loans"]
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SERIES_NAMES.items())
ORACLES["read_series"] = f"""WITH {SERIES}
SELECT series_id, CAST(observation_date AS STRING) AS observation_date, CAST(value AS DOUBLE) AS value,
  CASE series_id {_NAMES} END AS series_name
FROM series WHERE series_id <> 'OTHER' AND value IS NOT NULL"""
_filing = """SELECT concat('a-', CAST(o_orderkey AS STRING)) AS adsh, o_custkey AS cik, o_orderpriority AS company_name,
  CAST(NULL AS STRING) AS form_type, CAST(CAST(o_orderdate AS DATE) AS STRING) AS period, CAST(NULL AS INT) AS fy,
  CAST(NULL AS STRING) AS fp, '{tag}' AS tag, CAST({value} AS DOUBLE) AS value, '{uom}' AS uom FROM orders"""
ORACLES["flatten_filings"] = "\nUNION ALL\n".join(_filing.format(tag=t, value=v, uom=u) for t, v, u in (
    ("NetIncomeLoss", "o_totalprice", "USD"), ("Revenues", "o_custkey", "USD"), ("Assets", "o_totalprice", "USD"),
    ("Liabilities", "o_totalprice", "USD"), ("StockholdersEquity", "o_totalprice", "USD"),
    ("CashAndCashEquivalentsAtCarryingValue", "o_totalprice", "USD"),
    ("EarningsPerShareBasic", "o_totalprice", "USD/shares"), ("LongTermDebt", "o_totalprice", "USD")))
ORACLES["json_flatten"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events"

# ---- expressions ------------------------------------------------------------------------------

ORACLES["text_cleaning"] = f"""WITH {LOADS}
SELECT loan_id, trim(term) AS term, regexp_replace(term, '[^0-9]', '', 'g') AS term_digits,
  CAST(regexp_replace(term, '[^0-9]', '', 'g') AS INT) AS term_months, nullif(trim(emp_title), '') AS emp_title,
  TRY_CAST(nullif(regexp_replace(emp_length, '[^0-9]', '', 'g'), '') AS INT) AS emp_digits,
  CASE WHEN emp_length = '10+ years' THEN 11 WHEN emp_length = '< 1 year' THEN 0
       WHEN regexp_matches(emp_length, '^[0-9]+ year')
       THEN CAST(regexp_replace(emp_length, '[^0-9]', '', 'g') AS INT) END AS emp_years
FROM loads"""
ORACLES["date_parts"] = f"""WITH {LOADS}
SELECT loan_id, year(issue_date) AS y, month(issue_date) AS m,
  CAST(CAST(date_trunc('month', issue_date) AS DATE) AS STRING) AS month,
  date_part('year', age(issue_date, earliest_cr_line)) AS age_years,
  coalesce((year(issue_date) - year(earliest_cr_line)) * 12 + month(issue_date) - month(earliest_cr_line), 0) AS month_diff
FROM loads"""
ORACLES["guarded_ratios"] = f"""WITH {LOADS}
SELECT loan_id,
  round(CASE WHEN annual_inc > 0 THEN CAST(installment AS DOUBLE) * 12 / CAST(annual_inc AS DOUBLE) ELSE 0.0 END, 6) AS ratio,
  round(coalesce(CAST(revol_util AS DOUBLE), 0) / 100, 6) AS util, CAST(coalesce(dti, 0) AS DOUBLE) AS dti_eff,
  CASE WHEN pub_rec > 0 THEN 1 ELSE 0 END AS has_public_record,
  CASE WHEN dti IS NOT NULL THEN least(greatest(CAST(dti AS DOUBLE), 1.0), 30.0) END AS dti_clipped
FROM loads"""
ORACLES["null_defaults"] = f"""WITH {LOADS}
SELECT loan_id, CAST(coalesce(dti, 0) AS DOUBLE) AS dti, coalesce(delinq_2yrs, 0) AS delinq_2yrs,
  coalesce(pub_rec, 0) AS pub_rec, CAST(coalesce(revol_util, 0) AS DOUBLE) AS revol_util,
  CAST(coalesce(recoveries, 0) AS DOUBLE) AS recoveries FROM loads"""
ORACLES["number_coercion"] = f"""WITH {LOADS}
SELECT loan_id, TRY_CAST(zip_code AS DOUBLE) AS zip_number, TRY_CAST(substr(sub_grade, 2, 1) AS DOUBLE) AS grade_number
FROM loads"""
ORACLES["target_labels"] = f"""WITH {LOADS}
SELECT loan_id, CASE WHEN loan_status IN ('Charged Off', 'Default', 'Late (31-120 days)') THEN 1
    WHEN loan_status = 'Fully Paid' THEN 0 END AS is_default,
  CASE WHEN home_ownership IN ('MORTGAGE', 'OWN') THEN 1 ELSE 0 END AS privileged FROM loads"""
ORACLES["decision_table"] = f"""SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS score_id,
  round({A.SCORED["score"]}, 6) AS risk_score,
  CASE WHEN {A.SCORED["score"]} < 0.10 THEN 'low' WHEN {A.SCORED["score"]} < 0.25 THEN 'medium' ELSE 'high' END AS risk_tier,
  CASE WHEN {A.SCORED["score"]} < 0.20 THEN 1 ELSE 0 END AS approved FROM lineitem"""
ORACLES["value_differences"] = """SELECT l_orderkey, l_partkey,
  CASE WHEN abs(l_extendedprice - floor(l_extendedprice)) / greatest(l_extendedprice, 1.0) > 1e-6 THEN 1 ELSE 0 END AS differs,
  CASE WHEN l_returnflag <> l_linestatus THEN 1 ELSE 0 END AS text_differs,
  CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS STRING)
       ELSE printf('%.2f', l_extendedprice) END AS shown,
  CAST(CAST(l_quantity AS BIGINT) AS STRING) AS shown_quantity,
  CASE WHEN l_extendedprice > 50000 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM lineitem"""

# ---- dedup, upsert, series --------------------------------------------------------------------

ORACLES["latest_load_per_member"] = f"""WITH {LOADS}
SELECT member_id, loan_id, {_plain([*A.LOAD_TIEBREAK, "loaded_at"])} FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY loaded_at DESC, {_TIE}, loan_id DESC) AS rn FROM loads) q
WHERE rn = 1"""
_SEQ = "loaded_at, " + ", ".join(A.LOAD_TIEBREAK)
_SEQ_DESC = "loaded_at DESC, " + ", ".join(f"{c} DESC" for c in A.LOAD_TIEBREAK)
ORACLES["partial_upsert"] = f"""WITH {LOADS},
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY {_SEQ_DESC}) AS rn FROM loads
  WHERE loaded_at < TIMESTAMP '1998-07-01') q WHERE rn = 1),
arriving AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY {_SEQ}) AS first_rn,
  row_number() OVER (PARTITION BY loan_id ORDER BY {_SEQ_DESC}) AS last_rn FROM loads
  WHERE loaded_at >= TIMESTAMP '1998-07-01'),
f AS (SELECT * FROM arriving WHERE first_rn = 1), l AS (SELECT * FROM arriving WHERE last_rn = 1)
SELECT coalesce(b.loan_id, f.loan_id) AS loan_id,
  CAST(CASE WHEN b.loan_id IS NOT NULL THEN b.loan_amnt ELSE f.loan_amnt END AS DOUBLE) AS loan_amnt,
  CASE WHEN b.loan_id IS NOT NULL THEN b.term ELSE f.term END AS term,
  CAST(CASE WHEN b.loan_id IS NOT NULL THEN b.int_rate ELSE f.int_rate END AS DOUBLE) AS int_rate,
  CASE WHEN l.loan_id IS NOT NULL THEN l.loan_status ELSE b.loan_status END AS loan_status,
  CAST(CASE WHEN l.loan_id IS NOT NULL THEN l.total_pymnt ELSE b.total_pymnt END AS DOUBLE) AS total_pymnt,
  CAST(CASE WHEN l.loan_id IS NOT NULL THEN l.last_pymnt_date ELSE b.last_pymnt_date END AS STRING) AS last_pymnt_date,
  CAST(CASE WHEN l.loan_id IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE b.loaded_at END AS STRING) AS loaded_at
FROM base b FULL OUTER JOIN f ON b.loan_id = f.loan_id LEFT JOIN l ON l.loan_id = f.loan_id"""
ORACLES["series_upsert"] = f"""WITH {SERIES},
g AS (SELECT series_id, observation_date, min(value) AS lo, max(value) AS hi FROM series GROUP BY 1, 2)
SELECT series_id, CAST(observation_date AS STRING) AS observation_date,
  CAST(CASE WHEN day(observation_date) >= 10 THEN hi ELSE lo END AS DOUBLE) AS value FROM g"""
ORACLES["last_per_month"] = f"""WITH {MONTHLY}
SELECT series_id, CAST(observation_date AS STRING) AS observation_date, CAST(value AS DOUBLE) AS value,
  CAST(month AS STRING) AS month FROM monthly"""
ORACLES["pivot_series"] = f"""WITH {SERIES}
SELECT CAST(CAST(date_trunc('month', observation_date) AS DATE) AS STRING) AS month,
  {", ".join(f"CAST(max(CASE WHEN series_id = '{k}' THEN value END) AS DOUBLE) AS {v}" for k, v in S.SERIES_COLUMNS.items())}
FROM series GROUP BY 1"""
_BY_SERIES = "OVER (PARTITION BY series_id ORDER BY month)"
ORACLES["lag_diff"] = f"""WITH {MONTHLY}
SELECT series_id, CAST(month AS STRING) AS month, round(CAST(value AS DOUBLE), 6) AS value,
  round(CAST(value AS DOUBLE) - lag(CAST(value AS DOUBLE), 12) {_BY_SERIES}, 6) AS yoy_change FROM monthly"""
ORACLES["lag_growth"] = f"""WITH {MONTHLY}
SELECT series_id, CAST(month AS STRING) AS month, CAST(value AS DOUBLE) AS value,
  round((CAST(value AS DOUBLE) - lag(value) {_BY_SERIES}) / nullif(lag(value) {_BY_SERIES}, 0) * 100, 4) AS growth FROM monthly"""
ORACLES["series_lags"] = f"""WITH {MONTHLY}
SELECT series_id, CAST(month AS STRING) AS month, CAST(value AS DOUBLE) AS value,
  CAST(lag(value, 3) {_BY_SERIES} AS DOUBLE) AS lag3, CAST(lag(value, 6) {_BY_SERIES} AS DOUBLE) AS lag6 FROM monthly"""

# ---- quality ----------------------------------------------------------------------------------

_FAILS = {
    "not_null_loan_id": "loan_id IS NULL", "not_null_dti": "dti IS NULL",
    "not_null_home_ownership": "home_ownership IS NULL", "not_null_loan_status": "loan_status IS NULL",
    "accepted_loan_status": "loan_status NOT IN ('Fully Paid', 'Charged Off', 'Current')",
    "check_loan_amnt_positive": "NOT (loan_amnt > 0)",
    "check_int_rate_range": "NOT (int_rate >= 0 AND int_rate <= 100)",
    "check_annual_inc_not_negative": "NOT (annual_inc >= 0)", "check_dti_not_negative": "NOT (dti >= 0)",
}


def _summary(fails: dict[str, str], source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{rule}' AS rule, count(*) AS n_rows, count(CASE WHEN {cond} THEN 1 END) AS n_failed, "
        f"CASE WHEN count(CASE WHEN {cond} THEN 1 END) = 0 THEN 1 ELSE 0 END AS passed FROM {source}"
        for rule, cond in fails.items())


def _unique(keys: str, rule: str, source: str) -> str:
    return (f"SELECT '{rule}' AS rule, CAST(sum(n) AS BIGINT) AS n_rows, count(CASE WHEN n > 1 THEN 1 END) AS n_failed, "
            f"CASE WHEN count(CASE WHEN n > 1 THEN 1 END) = 0 THEN 1 ELSE 0 END AS passed "
            f"FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}) g")


ORACLES["quality_summary"] = f"""WITH {LOADS}
{_summary(_FAILS, "loads")}
UNION ALL
{_unique("loan_id", "unique_loan_id", "loads")}
UNION ALL
{_unique("loan_id, loaded_at", "unique_loan_id_loaded_at", "loads")}"""
ORACLES["quality_violations"] = f"WITH {LOADS}\n" + "\nUNION ALL\n".join(
    f"SELECT '{rule}' AS rule, CAST(loan_id AS STRING) AS key FROM loads WHERE {cond}" for rule, cond in _FAILS.items())
ORACLES["unique_violations"] = f"WITH {LOADS} SELECT loan_id, count(*) AS n_rows FROM loads GROUP BY 1 HAVING count(*) > 1"
ORACLES["applicant_contract"] = f"WITH {LOADS}\n" + _summary(
    {f"check_{k}": f"NOT ({v})" for k, v in S.APPLICANT_CHECKS.items()}, "loads")
ORACLES["mart_quality"] = f"WITH {FINAL}\n" + _summary({
    "not_null_id": "id IS NULL", "not_null_installment_to_income_ratio": "installment_to_income_ratio IS NULL",
    "accepted_is_default": "is_default NOT IN (0, 1)"}, "final") + "\nUNION ALL\n" + _unique("id", "unique_id", "final")


def _table_summary(table: str, fails: dict[str, str], source: str, unique: str | None = None) -> str:
    parts = _summary(fails, source) + (f"\nUNION ALL\n{_unique(unique, f'unique_{unique}', source)}" if unique else "")
    return f"SELECT '{table}' AS table_name, * FROM ({parts})"


ORACLES["source_quality"] = f"WITH {LOADS},\n{SERIES}\n" + _table_summary("raw_loans", {
    "not_null_loan_id": "loan_id IS NULL", "not_null_loan_amnt": "loan_amnt IS NULL",
    "not_null_issue_date": "issue_date IS NULL", "not_null_loan_status": "loan_status IS NULL",
    "check_loan_amnt_positive": "NOT (loan_amnt > 0)",
    "check_int_rate_range": "NOT (int_rate >= 0 AND int_rate <= 100)",
    "check_annual_inc_not_negative": "NOT (annual_inc >= 0)", "check_dti_not_negative": "NOT (dti >= 0)",
}, "loads", "loan_id") + "\nUNION ALL\n" + _table_summary("raw_series", {
    "not_null_series_id": "series_id IS NULL", "not_null_observation_date": "observation_date IS NULL",
    "not_null_value": "value IS NULL", "check_value_present": "NOT (value IS NOT NULL)"}, "series")
ORACLES["staging_quality"] = f"WITH {STAGING},\n{_macro()}\n" + _table_summary(
    "staging_loans", {"not_null_loan_id": "loan_id IS NULL"}, "staging", "loan_id") + "\nUNION ALL\n" + _table_summary(
    "staging_macro", {"not_null_observation_month": "observation_month IS NULL"}, "macro", "observation_month")
ORACLES["macro_quality"] = f"WITH {_macro_lags()}\n" + _table_summary(
    "macro_features", {"not_null_date": "date IS NULL"}, "macro_lags", "date")

# ---- preparation ------------------------------------------------------------------------------

ORACLES["temporal_split_counts"] = f"""WITH {FINAL}
SELECT CASE WHEN issue_d <= DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  CAST(sum(is_default) AS BIGINT) AS n_default
FROM final WHERE is_default IS NOT NULL AND issue_d IS NOT NULL GROUP BY 1"""
ORACLES["median_impute"] = f"WITH {FINAL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0), 6) AS median FROM final"
    for c in S.NUMERICAL_FEATURES)
ORACLES["imputed_features"] = f"WITH {FINAL}\nSELECT id, " + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM final)), 6) AS {c}"
    for c in S.NUMERICAL_FEATURES) + " FROM final"
ORACLES["category_codes"] = f"WITH {FINAL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, v AS category, row_number() OVER (ORDER BY v) - 1 AS code "
    f"FROM (SELECT DISTINCT coalesce({c}, 'MISSING') AS v FROM final) d" for c in S.CATEGORICAL_FEATURES)
ORACLES["encoded_features"] = f"WITH {FINAL}\nSELECT id, " + ", ".join(
    f"dense_rank() OVER (ORDER BY coalesce({c}, 'MISSING')) - 1 AS {c}" for c in S.CATEGORICAL_FEATURES) + " FROM final"
_PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
ORACLES["exact_quantiles"] = f"WITH {SCORED}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {i} AS i, round(quantile_cont({c}, {p}), 6) AS q FROM scored"
    for c in A.DRIFT_FEATURES for i, p in enumerate(_PROBS))

# ---- snapshot ---------------------------------------------------------------------------------


def _latest_event(cond: str) -> str:
    return f"""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE {cond}) q
WHERE rn = 1"""


ORACLES["snapshot_latest"] = _latest_event("ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
ORACLES["snapshot_incremental"] = _latest_event("ts BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2024-01-25'")
ORACLES["snapshot_stream"] = _latest_event("ts IS NOT NULL")
_ALIVE = "f.issue_d >= DATE '2007-01-01' - INTERVAL 3650 DAY"
ORACLES["feature_lookup"] = f"""WITH {FINAL}
SELECT p_partkey * 3 AS id, CASE WHEN {_ALIVE} THEN CAST(loan_amnt AS DOUBLE) END AS loan_amnt,
  CASE WHEN {_ALIVE} THEN CAST(dti_eff AS DOUBLE) END AS dti_eff, CASE WHEN {_ALIVE} THEN purpose END AS purpose,
  CASE WHEN {_ALIVE} THEN round(CAST(cpi AS DOUBLE), 6) END AS cpi,
  CASE WHEN {_ALIVE} THEN 1 ELSE 0 END AS is_present
FROM part LEFT JOIN final f ON f.id = p_partkey * 3"""

# ---- classification metrics -------------------------------------------------------------------


def _curve(score: str = "score") -> str:
    return f"""{SCORED},
counts AS (SELECT {score} AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM counts),
rates AS (SELECT CAST(score AS DOUBLE) AS score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
  CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n FROM cum),
curve AS (SELECT *, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS prec,
  coalesce(lag(tp / p) OVER (ORDER BY score DESC), 0) AS prev_tpr,
  coalesce(lag(fp / n) OVER (ORDER BY score DESC), 0) AS prev_fpr,
  coalesce(lag(tp / (tp + fp)) OVER (ORDER BY score DESC), 1) AS prev_prec FROM rates)"""


_ROC = "sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2)"
_PR = "sum((tpr - prev_tpr) * (prec + prev_prec) / 2)"
_BEST = "FROM curve ORDER BY tpr - fpr DESC, score DESC LIMIT 1"


def _bin_case(score: str, bins: int, right: bool = False) -> str:
    """Bin number by comparing with the edges."""
    op = ">" if right else ">="
    whens = " ".join(f"WHEN {score} {op} CAST('{e!r}' AS DOUBLE) THEN {i + 1}"
                     for i, e in reversed(list(enumerate(unit_edges(bins)[1:-1]))))
    return f"CASE WHEN {score} < 0 OR {score} > 1 THEN NULL {whens} ELSE 0 END"


def _calibration(score: str) -> str:
    return f"""(SELECT avg(({score} - label) * ({score} - label)) FROM scored) AS brier_score,
  (SELECT sum(abs(y - s) * n) / sum(n) FROM (SELECT {_bin_case(score, 10)} AS bin, avg(label) AS y, avg({score}) AS s,
     count(*) AS n FROM scored GROUP BY 1) b) AS ece"""


ORACLES["roc_auc"] = f"WITH {_curve()} SELECT round({_ROC}, 6) AS roc_auc FROM curve"
ORACLES["pr_auc"] = f"WITH {_curve()} SELECT round({_PR}, 6) AS pr_auc FROM curve"
ORACLES["recall_at_precision"] = f"""WITH {_curve()}
SELECT round(coalesce(max(CASE WHEN prec >= 0.335 THEN tpr END), 0), 6) AS recall FROM curve"""
ORACLES["ks_by_label"] = f"WITH {_curve()} SELECT round(max(abs(tpr - fpr)), 6) AS ks_statistic FROM curve"
ORACLES["best_threshold"] = f"WITH {_curve()} SELECT round(score, 6) AS best_threshold {_BEST}"
ORACLES["confusion"] = f"""WITH {SCORED}
SELECT count(CASE WHEN label = 0 AND score < 0.5 THEN 1 END) AS tn, count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS fp,
  count(CASE WHEN label = 1 AND score < 0.5 THEN 1 END) AS fn, count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS tp
FROM scored"""
ORACLES["brier_ece"] = f"""WITH {SCORED}, c AS (SELECT {_calibration("score")})
SELECT round(brier_score, 6) AS brier_score, round(ece, 6) AS ece FROM c"""


def _extended(score: str) -> str:
    return f"""{_curve(score)},
best AS (SELECT * {_BEST}),
m AS (SELECT (SELECT {_PR} FROM curve) AS pr_auc, (SELECT {_ROC} FROM curve) AS roc_auc,
  (SELECT coalesce(max(CASE WHEN prec >= 0.8 THEN tpr END), 0) FROM curve) AS recall_at_p80,
  (SELECT max(abs(tpr - fpr)) FROM curve) AS ks_statistic, best.score AS best_threshold,
  CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
  {_calibration(score)} FROM best)"""


_METRICS = ["pr_auc", "roc_auc", "recall_at_p80", "ks_statistic", "best_threshold", "brier_score", "ece"]
ORACLES["extended_metrics"] = (f"WITH {_extended('fine_score')} SELECT "
                               + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + ", tn, fp, fn, tp FROM m")
ORACLES["flatten_metrics"] = f"WITH {_extended('score')}\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM m"
    for n, c in [*[(c, c) for c in _METRICS], *[(f"cm_{c}", c) for c in ("tn", "fp", "fn", "tp")]])
ORACLES["metrics_gate"] = f"WITH {_curve()} SELECT CASE WHEN {_PR} >= 0.30 THEN 1 ELSE 0 END AS passed FROM curve"
_E20 = unit_edges(20)
ORACLES["score_histogram"] = f"""WITH {SCORED},
edges AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_E20[i]!r}, {_E20[i + 1]!r})" for i in range(20))}) t(bin, lo, hi)),
b AS (SELECT {_bin_case("score", 20)} AS bin, count(*) AS n FROM scored GROUP BY 1)
SELECT round(CAST(lo AS DOUBLE), 6) AS bin_lo, round(CAST(hi AS DOUBLE), 6) AS bin_hi, coalesce(n, 0) AS count
FROM edges LEFT JOIN b ON edges.bin = b.bin"""
ORACLES["calibration_curve"] = f"""WITH {SCORED}
SELECT {_bin_case("score", 10, True)} AS bin, round(avg(score), 6) AS prob_pred, round(avg(label), 6) AS prob_true,
  count(*) AS n FROM scored GROUP BY 1"""
ORACLES["roc_points"] = f"""WITH {_curve()}
SELECT round(score, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve
UNION ALL SELECT NULL, 0.0, 0.0"""
ORACLES["pr_points"] = f"""WITH {_curve()}
SELECT round(score, 9) AS threshold, round(prec, 9) AS precision, round(tpr, 9) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0"""

# ---- drift ------------------------------------------------------------------------------------


def _drift(features: list[str], ref: str, cur: str, threshold: float = 0.25) -> str:
    """psi / ks per feature; ``ref`` and ``cur`` name frames of doubles."""
    longs = {side: " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src} WHERE {f} IS NOT NULL" for f in features)
        for side, src in (("r", ref), ("c", cur))}
    probs = ", ".join(str(i / 10) for i in range(11))
    inner = " + ".join(f"CASE WHEN {i} < len(e) AND e[{i}] <= v THEN 1 ELSE 0 END" for i in range(2, 11))
    return f"""names AS (SELECT unnest([{", ".join(f"'{f}'" for f in features)}]) AS feature),
r AS ({longs["r"]}),
c AS ({longs["c"]}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS e FROM r GROUP BY 1),
both_sides AS (SELECT feature, v, 1 AS is_ref FROM r UNION ALL SELECT feature, v, 0 FROM c),
binned AS (
  SELECT feature, len(e) AS n_edges, {inner} AS bin, sum(is_ref) AS a, sum(1 - is_ref) AS b
  FROM both_sides JOIN edges USING (feature) GROUP BY 1, 2, 3),
shares AS (
  SELECT feature, n_edges, greatest(a / greatest(sum(a) OVER (PARTITION BY feature), 1), 1e-6) AS ref_share,
    greatest(b / greatest(sum(b) OVER (PARTITION BY feature), 1), 1e-6) AS cur_share FROM binned),
psis AS (SELECT feature, sum(CASE WHEN n_edges < 2 THEN 0 ELSE (cur_share - ref_share) * ln(cur_share / ref_share) END) AS psi
  FROM shares GROUP BY 1),
cum AS (
  SELECT feature, v, sum(sum(is_ref)) OVER w AS cr, sum(sum(1 - is_ref)) OVER w AS cc,
    sum(sum(is_ref)) OVER (PARTITION BY feature) AS tr, sum(sum(1 - is_ref)) OVER (PARTITION BY feature) AS tc
  FROM both_sides GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v)),
kss AS (SELECT feature, max(CASE WHEN tr > 0 AND tc > 0 THEN abs(cr / tr - cc / tc) END) AS ks FROM cum GROUP BY 1),
report AS (
  SELECT feature, coalesce(psi, 0) AS psi, coalesce(ks, 0) AS ks_statistic,
    CASE WHEN coalesce(psi, 0) >= {threshold} THEN 1 ELSE 0 END AS drifted
  FROM names LEFT JOIN psis USING (feature) LEFT JOIN kss USING (feature))"""


_SIDES = f"""{SCORED},
ref AS (SELECT * FROM scored WHERE shipped <= DATE '{A.DRIFT_CUTOFF}'),
cur AS (SELECT * FROM scored WHERE shipped > DATE '{A.DRIFT_CUTOFF}'),
{_drift(A.DRIFT_FEATURES, "ref", "cur")}"""
_REPORT = "round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, drifted"
ORACLES["psi"] = f"WITH {_SIDES} SELECT feature, round(psi, 6) AS psi FROM report"
ORACLES["ks_two_sample"] = f"WITH {_SIDES} SELECT feature, round(ks_statistic, 6) AS ks_statistic FROM report"
ORACLES["drift_report"] = f"WITH {_SIDES} SELECT feature, {_REPORT} FROM report"
ORACLES["drift_summary"] = f"""WITH {_SIDES}
SELECT CAST(count(*) AS INT) AS n_features, CAST(sum(drifted) AS INT) AS n_drifted, round(avg(drifted), 6) AS drift_share,
  max(drifted) AS dataset_drift FROM report"""
_SPLIT = f"""{FINAL},
train AS (SELECT * FROM final WHERE is_default IS NOT NULL AND issue_d <= DATE '{CUTOFF}'),
test AS (SELECT * FROM final WHERE is_default IS NOT NULL AND issue_d > DATE '{CUTOFF}')"""
ORACLES["drift_final_features"] = (f"WITH {_SPLIT},\n{_drift(S.NUMERICAL_FEATURES, 'train', 'test')}\n"
                                   f"SELECT feature, {_REPORT} FROM report")
ORACLES["null_shares"] = f"WITH {_SPLIT}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round((SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM train), 6) AS ref_null_share, "
    f"round((SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM test), 6) AS cur_null_share"
    for c in ("unemployment_rate", "cpi_lag6", "loan_amnt"))

# ---- fairness ---------------------------------------------------------------------------------


def _fair(attr: str, values: list[str]) -> str:
    priv = f"coalesce({attr} IN ({', '.join(repr(v) for v in values)}), false)"
    return f"""SELECT '{attr}' AS attribute, count(CASE WHEN p THEN 1 END) AS n_privileged,
  count(CASE WHEN NOT p THEN 1 END) AS n_unprivileged,
  avg(CASE WHEN NOT p THEN g END) / avg(CASE WHEN p THEN g END) AS di,
  avg(CASE WHEN NOT p THEN g END) - avg(CASE WHEN p THEN g END) AS spd,
  avg(CASE WHEN NOT p AND is_default = 0 THEN g END) - avg(CASE WHEN p AND is_default = 0 THEN g END) AS eod
FROM (SELECT {priv} AS p, is_default, CASE WHEN (open_acc + total_acc + inq_last_6mths) / 70.0 >= 0.2 THEN 0.0 ELSE 1.0 END AS g
      FROM final WHERE is_default IS NOT NULL) d"""


_FAIR = f"WITH {FINAL}, fair AS (" + "\nUNION ALL\n".join(_fair(a, v) for a, v in S.PROTECTED_ATTRIBUTES.items()) + ")"
_FAIR_COLS = """attribute, n_privileged, n_unprivileged, round(di, 6) AS disparate_impact_ratio,
  round(spd, 6) AS statistical_parity_difference, round(eod, 6) AS equal_opportunity_difference,
  CASE WHEN di BETWEEN 0.8 AND 1.25 THEN 1 ELSE 0 END AS di_within_policy"""
ORACLES["fairness_metrics"] = f"{_FAIR} SELECT {_FAIR_COLS} FROM fair"
ORACLES["fairness_audit"] = f"""{_FAIR} SELECT {_FAIR_COLS}, 'shares' AS model_name,
  min(CASE WHEN di BETWEEN 0.8 AND 1.25 THEN 1 ELSE 0 END) OVER () AS overall_pass FROM fair"""

# ---- monitoring -------------------------------------------------------------------------------

_FD = """fd AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS run_ts, concat(l_returnflag, l_linestatus) AS feature,
    avg(l_discount) * 5 AS psi, avg(l_tax) * 5 AS ks_statistic FROM lineitem GROUP BY 1, 2),
last AS (SELECT * FROM fd WHERE run_ts = (SELECT max(run_ts) FROM fd))"""
_MM = """mm AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS run_ts, avg(l_discount) * 10 AS roc_auc,
    avg(l_tax) * 10 AS pr_auc, avg(l_quantity) / 50 AS ks_statistic FROM lineitem GROUP BY 1)"""
ORACLES["recent_count"] = """SELECT count(*) AS scored FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 24 HOUR"""
ORACLES["latest_drift_status"] = f"WITH {_FD} SELECT max(CASE WHEN psi >= 0.25 THEN 1 ELSE 0 END) AS status FROM last"
ORACLES["latest_n_drifted"] = f"WITH {_FD} SELECT count(CASE WHEN psi >= 0.25 THEN 1 END) AS n_drifted FROM last"
ORACLES["latest_metric"] = f"WITH {_MM} SELECT round(pr_auc, 8) AS pr_auc FROM mm ORDER BY run_ts DESC LIMIT 1"
ORACLES["latest_run_psi"] = f"WITH {_FD} SELECT feature, round(psi, 8) AS psi FROM last"
ORACLES["latest_run_ks"] = f"WITH {_FD} SELECT feature, round(ks_statistic, 8) AS ks_statistic FROM last"
ORACLES["latest_bins"] = f"""WITH s AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS run_ts, {A.SCORED["score"]} AS score FROM lineitem),
b AS (SELECT {_bin_case("score", 20)} AS bin, count(*) AS count FROM s WHERE run_ts = (SELECT max(run_ts) FROM s) GROUP BY 1)
SELECT CAST(CAST(bin / 20.0 AS DECIMAL(18,2)) AS STRING) AS bucket, count FROM b"""
ORACLES["metric_trend"] = f"""WITH {_MM} SELECT CAST(run_ts AS STRING) AS time, round(roc_auc, 8) AS roc_auc,
  round(pr_auc, 8) AS pr_auc, round(ks_statistic, 8) AS ks_statistic FROM mm"""
ORACLES["drift_alerts"] = f"WITH {_FD} SELECT feature, round(psi, 8) AS psi, round(ks_statistic, 8) AS ks_statistic FROM last WHERE psi >= 0.25 OR ks_statistic >= 0.2"

# ---- survival ---------------------------------------------------------------------------------


def _km(event: str = "event = 1", by: str = "") -> str:
    part, sel = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""km0 AS (SELECT {sel}duration_months AS t, count(CASE WHEN {event} THEN 1 END) AS d, count(*) AS n
  FROM surv GROUP BY ALL),
km1 AS (SELECT *, sum(n) OVER ({part}ORDER BY t DESC) AS at_risk FROM km0),
km AS (SELECT {sel}t, d, n, CAST(at_risk AS BIGINT) AS at_risk, CASE WHEN d = at_risk THEN 0 ELSE
  exp(sum(CASE WHEN d = at_risk THEN 0 ELSE ln(1 - CAST(d AS DOUBLE) / at_risk) END) OVER ({part}ORDER BY t)) END AS surv
  FROM km1)"""


ORACLES["survival_frame"] = f"""WITH {SURVIVAL}
SELECT CAST(issue_d AS STRING) AS issue_d, CAST(term_months AS INT) AS term_months, quantity, event,
  round(duration_months, 6) AS duration_months FROM surv"""
ORACLES["kaplan_meier"] = f"""WITH {SURVIVAL}, {_km()}
SELECT round(t, 6) AS t, d, n, at_risk, round(surv, 6) AS surv FROM km"""
ORACLES["kaplan_meier_by_term"] = f"""WITH {SURVIVAL.replace("surv AS (", "surv0 AS (")},
surv AS (SELECT *, CAST(coalesce(term_months, 0) AS INT) AS grp FROM surv0), {_km(by="grp")}
SELECT grp, round(t, 6) AS t, d, n, at_risk, round(surv, 6) AS surv FROM km"""
ORACLES["censoring_curve"] = f"""WITH {SURVIVAL}, {_km("event = 0")} SELECT round(t, 6) AS t, round(surv, 6) AS surv FROM km"""
ORACLES["concordance"] = f"""WITH {SURVIVAL},
ranked AS (SELECT 2 * dense_rank() OVER (ORDER BY duration_months) + CASE WHEN event = 1 THEN 0 ELSE 1 END AS k,
  event, score AS s FROM surv),
cells AS (SELECT k, s, count(*) AS n, max(event) AS e FROM ranked GROUP BY 1, 2),
ks AS (SELECT k, max(e) AS e FROM cells GROUP BY 1),
grid AS (SELECT ks.k, ks.e, ss.s, coalesce(c.n, 0) AS n FROM ks CROSS JOIN (SELECT DISTINCT s FROM cells) ss
  LEFT JOIN cells c ON c.k = ks.k AND c.s = ss.s),
later AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS later FROM grid),
gt AS (SELECT *, coalesce(sum(later) OVER (PARTITION BY k ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS gt, sum(later) OVER (PARTITION BY k) AS all_later FROM later),
t AS (SELECT CAST(sum(n * gt) AS DOUBLE) AS concordant, CAST(sum(n * later) AS DOUBLE) AS tied,
  CAST(sum(n * all_later) AS DOUBLE) AS comparable FROM gt WHERE e = 1)
SELECT concordant, tied, comparable, round((concordant + tied / 2) / comparable, 6) AS c_index FROM t"""
_BRIER = f"""{SURVIVAL}, {_km("event = 0")},
g AS (SELECT t, surv AS g_at, coalesce(lag(surv) OVER (ORDER BY t), 1) AS g_before FROM km),
weighted AS (SELECT s.*, g.g_before FROM surv s JOIN g ON g.t = s.duration_months),
brier AS (""" + "\nUNION ALL\n".join(f"""SELECT {t} AS t, sum(CASE
    WHEN duration_months <= {t} AND event = 1 THEN {c} * {c} / greatest(g_before, 1e-6)
    WHEN duration_months > {t} THEN (1 - {c}) * (1 - {c}) / greatest(
      coalesce((SELECT arg_max(g_at, t) FROM g WHERE t <= {t}), 1), 1e-6) ELSE 0 END) / count(*) AS brier FROM weighted"""
                                       for t, c in A.HORIZONS.items()) + ")"
ORACLES["brier_scores"] = f"WITH {_BRIER} SELECT CAST(t AS DOUBLE) AS t, round(brier, 6) AS brier FROM brier"
ORACLES["integrated_brier"] = f"""WITH {_BRIER}, p AS (SELECT t, brier, lag(t) OVER (ORDER BY t) AS pt,
  lag(brier) OVER (ORDER BY t) AS pb FROM brier)
SELECT round(sum((t - pt) * (brier + pb) / 2) / (max(t) - min(t)), 6) AS ibs FROM p"""
ORACLES["step_lookup"] = f"""WITH {SURVIVAL}, {_km()}
SELECT o_orderkey, round(coalesce(surv, 1.0), 6) AS surv
FROM (SELECT o_orderkey, o_totalprice / 10000.0 AS at FROM orders) p ASOF LEFT JOIN km ON p.at >= km.t"""
ORACLES["curve_area"] = f"""WITH {SURVIVAL}, {_km()}, p AS (SELECT t, surv, lag(t) OVER (ORDER BY t) AS pt,
  lag(surv) OVER (ORDER BY t) AS ps FROM km)
SELECT round(sum((t - pt) * (surv + ps) / 2), 6) AS area FROM p"""

# ---- prediction and attribution with given coefficients -----------------------------------------

_GIVEN = f"""{SURVIVAL}, {_km()},
base AS (SELECT t, -ln(surv) AS h0 FROM km WHERE surv > 0),
risk AS (SELECT *, exp(0.02 * (quantity - 25.0) + -3.0 * (discount - 0.05)) AS r FROM surv)"""


def _h0(t: int) -> str:
    return f"coalesce((SELECT max(h0) FROM base WHERE t <= {t}), 0)"


ORACLES["given_survival_at"] = f"""WITH {_GIVEN}
SELECT CAST(issue_d AS STRING) AS issue_d, quantity, round(discount, 6) AS discount,
  {", ".join(f"round(exp(-{_h0(t)} * r), 6) AS surv_{t}" for t in (12, 24, 36))} FROM risk"""
ORACLES["given_median_survival"] = f"""WITH {_GIVEN},
first_at AS (SELECT h0, min(t) AS t FROM base GROUP BY 1)
SELECT CAST(issue_d AS STRING) AS issue_d, quantity, round(discount, 6) AS discount, round(t, 6) AS median
FROM (SELECT *, ln(2) / r AS level FROM risk) p ASOF LEFT JOIN first_at ON p.level <= first_at.h0"""
ORACLES["given_survival_curves"] = f"""WITH {_GIVEN},
people AS (SELECT DISTINCT concat(CAST(quantity AS INT), '/', CAST(round(discount * 100) AS INT)) AS id, r FROM risk)
SELECT id, round(t, 6) AS t, round(exp(-h0 * r), 6) AS surv FROM people CROSS JOIN base"""
_CARD = {"loan_amnt": "0.00001", "int_rate": "0.15", "annual_inc": "-0.00002", "dti_eff": "0.03", "open_acc": "-0.01"}
_ATTR = f"""WITH {FINAL},
x AS (SELECT id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _CARD)} FROM final),
m AS (SELECT {", ".join(f"avg({f}) AS {f}" for f in _CARD)} FROM x),
attr AS (""" + " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, {w} * (x.{f} - m.{f}) AS attribution FROM x CROSS JOIN m" for f, w in _CARD.items()) + """)"""
_BASE_VALUE = " + ".join(f"{w} * {f}" for f, w in _CARD.items())
ORACLES["scorecard_attributions"] = f"""{_ATTR}
SELECT id, feature, round(attribution, 6) AS attribution, round((SELECT -2.0 + {_BASE_VALUE} FROM m), 6) AS base_value FROM attr"""
ORACLES["scorecard_top"] = f"""{_ATTR}
SELECT id, feature, round(attribution, 6) AS attribution, rank,
  CASE WHEN attribution > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(attribution) DESC, feature) AS rank FROM attr) q WHERE rank <= 2"""
ORACLES["scorecard_importance"] = f"{_ATTR} SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM attr GROUP BY 1"
ORACLES["scorecard_records"] = f"""{_ATTR}
SELECT id AS loan_id, 'scorecard' AS model_name, feature, round(attribution, 6) AS attribution FROM attr"""
for _name in ("linear_additivity", "tree_additivity", "hist_boost_additivity"):
    ORACLES[_name] = f"WITH {FINAL}\nSELECT id, 1 AS adds_up FROM final WHERE is_default IS NOT NULL"

_BOOST = {"loan_amnt": [50000, 120000, 200000], "dti_eff": [5, 15, 25], "annual_inc": [20000, 60000]}
# every cut, the one above all values (NULL) too, with missing values on either side
_BOOST_CUTS = ", ".join(f"({i}, '{f}', {k}, CAST({'NULL' if c is None else c} AS DOUBLE), {left})" for i, (f, cuts) in enumerate(_BOOST.items())
                        for k, c in enumerate([*cuts, None]) for left in ("true", "false"))


def _boost_level(rows: str, out: str) -> str:
    """Best split per node of ``rows``, and the rows moved to the children."""
    return f"""
{out}_sums AS (SELECT node, c.*, count(*) AS n, sum(g) AS g, sum(h) AS h, count(*) FILTER (goes) AS nl,
    coalesce(sum(g) FILTER (goes), 0) AS gl, coalesce(sum(h) FILTER (goes), 0) AS hl
  FROM (SELECT r.node, r.g, r.h, c.f, c.k, c.missing_left,
          CASE WHEN x[c.f + 1] IS NULL THEN c.missing_left ELSE c.cut IS NULL OR x[c.f + 1] <= c.cut END AS goes
        FROM {rows} r, cuts c) JOIN cuts c USING (f, k, missing_left) GROUP BY ALL),
{out}_best AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM {out}_sums
  WHERE nl > 0 AND nl < n AND hl >= 1 AND h - hl >= 1
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, missing_left DESC, k) = 1),
{out}_split AS (SELECT * FROM {out}_best WHERE gain > 0),
{out} AS (SELECT r.x, r.g, r.h, 2 * r.node + CASE WHEN CASE WHEN x[s.f + 1] IS NULL THEN s.missing_left
    ELSE s.cut IS NULL OR x[s.f + 1] <= s.cut END THEN 1 ELSE 2 END AS node FROM {rows} r JOIN {out}_split s USING (node))"""


_BOOST_X = ", ".join(f"CASE WHEN id % 5 <> {i} THEN CAST({f} AS DOUBLE) END" for i, f in enumerate(_BOOST))
ORACLES["hist_boost_tree"] = f"""WITH {FINAL},
cuts(f, feature, k, cut, missing_left) AS (VALUES {_BOOST_CUTS}),
root AS (SELECT [{_BOOST_X}] AS x, 0.5 - CAST(is_default AS DOUBLE) AS g, CAST(0.25 AS DOUBLE) AS h, 0 AS node FROM final
  WHERE is_default IS NOT NULL),{_boost_level("root", "one")},{_boost_level("one", "two")},
every AS (SELECT * FROM root UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two),
nodes AS (SELECT node, count(*) AS rows, sum(g) AS g, sum(h) AS h FROM every GROUP BY node),
splits AS (SELECT node, feature, cut, missing_left, gain FROM one_split UNION ALL
  SELECT node, feature, cut, missing_left, gain FROM two_split)
SELECT node, feature, round(cut, 6) AS cut, CASE WHEN missing_left THEN 'left' WHEN NOT missing_left THEN 'right' END
  AS missing_side, round(gain, 6) AS gain,
  round(-g / (h + 1), 6) AS value, rows, round(h, 6) AS hessian FROM nodes LEFT JOIN splits USING (node)"""

ORACLES["bucketed_upsert"] = ORACLES["partial_upsert"]
ORACLES["bucketed_snapshot"] = ORACLES["snapshot_stream"]
ORACLES["appended_metrics"] = ORACLES["metric_trend"]
ORACLES["feature_asof"] = """WITH h AS (SELECT user_id, ts, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type,
    arg_max(value, event_id) AS last_value FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.*, h.* EXCLUDE (user_id, ts), h.ts >= r.ts - INTERVAL 12 HOUR AS alive
  FROM r ASOF LEFT JOIN h ON r.user_id = h.user_id AND r.ts >= h.ts)
SELECT event_id, user_id, CASE WHEN alive THEN CAST(last_event AS DOUBLE) END AS last_event,
  CASE WHEN alive THEN last_type END AS last_type, CASE WHEN alive THEN last_value END AS last_value FROM j"""
_LINE = {"order_key": "l_orderkey", "line_number": "l_linenumber", **{c: A.SURVIVAL[c] for c in ("quantity", "discount")}}
ORACLES["line_survival_curves"] = f"""WITH {_GIVEN},
lines AS (SELECT {_cols(_LINE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
times AS ({" UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS t, {_h0(t)} AS h0" for t in (12, 24, 36, 48, 60))})
SELECT order_key, line_number, t, round(exp(-h0 * exp(0.02 * (quantity - 25.0) + -3.0 * (discount - 0.05))), 6) AS surv
FROM lines CROSS JOIN times"""
