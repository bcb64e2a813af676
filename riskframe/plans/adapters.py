"""Loan-like, series-like, scored and survival frames derived from the order / line-item tables.

The derivations are SQL text that reads the same in Spark SQL and ANSI SQL; every frame uses its
whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GRADE = "substr('ABCDEFG', CAST(1 + o_orderkey % 7 AS INT), 1)"

# one load of a loan per line item: loan attributes from the order and customer, changing ones
# from the line
LOADS = {
    "loan_id": "o_orderkey",
    "member_id": "o_custkey",
    "loan_amnt": "CAST(o_totalprice AS DECIMAL(12,2))",
    "funded_amnt": "CAST(o_totalprice AS DECIMAL(12,2))",
    "term": "CASE WHEN o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END",
    "int_rate": "CAST(5 + l_tax * 100 + l_discount * 50 AS DECIMAL(5,2))",
    "installment": "CAST(floor(o_totalprice / 36) AS DECIMAL(10,2))",
    "grade": _GRADE,
    "sub_grade": f"concat({_GRADE}, CAST(1 + o_orderkey % 5 AS STRING))",
    "emp_title": "CASE WHEN o_custkey % 10 = 0 THEN '  ' ELSE concat(' ', c_name, ' ') END",
    "emp_length": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10+ years' WHEN '2' THEN '< 1 year' "
                  "WHEN '3' THEN '3 years' WHEN '4' THEN '1 year' ELSE 'n/a' END",
    "home_ownership": "CASE c_nationkey % 4 WHEN 0 THEN 'MORTGAGE' WHEN 1 THEN 'OWN' WHEN 2 THEN 'RENT' END",
    "annual_inc": "CAST(c_acctbal * 10 AS DECIMAL(15,2))",
    "verification_status": "CASE o_custkey % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Not Verified' "
                           "ELSE 'Source Verified' END",
    "issue_date": "CAST(o_orderdate AS DATE)",
    "loan_status": "CASE WHEN o_orderstatus = 'F' THEN 'Fully Paid' WHEN o_orderstatus = 'P' THEN 'Charged Off' "
                   "WHEN l_returnflag = 'R' THEN 'Late (31-120 days)' ELSE 'Current' END",
    "purpose": "lower(c_mktsegment)",
    "title": "c_mktsegment",
    "zip_code": "concat(lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), 'xx')",
    "addr_state": "CASE c_nationkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'WA' "
                  "ELSE n_name END",
    "dti": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(l_quantity + l_discount * 10 - 1.5 AS DECIMAL(8,2)) END",
    "delinq_2yrs": "CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_quantity AS INT) % 3 END",
    "earliest_cr_line": "CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN CAST(l_shipdate AS DATE) "
                        "ELSE CAST(o_orderdate AS DATE) - CAST(365 * (1 + o_custkey % 20) + o_orderkey % 366 AS INT) END",
    "inq_last_6mths": "CAST(o_orderkey % 5 AS INT)",
    "open_acc": "CAST(o_custkey % 20 AS INT)",
    "pub_rec": "CASE WHEN o_custkey % 9 = 0 THEN 1 WHEN o_custkey % 9 = 1 THEN NULL ELSE 0 END",
    "revol_bal": "CAST(l_extendedprice AS DECIMAL(15,2))",
    "revol_util": "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_discount * 1000 AS DECIMAL(5,2)) END",
    "total_acc": "CAST(o_custkey % 40 AS INT)",
    "total_pymnt": "CAST(l_extendedprice AS DECIMAL(15,2))",
    "total_rec_prncp": "CAST(floor(l_extendedprice * 0.8) AS DECIMAL(15,2))",
    "total_rec_int": "CAST(floor(l_extendedprice * 0.2) AS DECIMAL(15,2))",
    "recoveries": "CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 0.1) AS DECIMAL(15,2)) END",
    "collection_recovery_fee": "CAST(l_linenumber AS DECIMAL(15,2))",
    "last_pymnt_date": "CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END",
    "last_pymnt_amnt": "CAST(l_quantity AS DECIMAL(15,2))",
    "application_type": "CASE WHEN o_orderkey % 4 = 0 THEN 'Joint App' ELSE 'Individual' END",
    "loaded_at": "CAST(l_shipdate AS TIMESTAMP)",
}
LOAD_TIEBREAK = ["revol_bal", "int_rate", "last_pymnt_amnt", "collection_recovery_fee", "loan_status"]

SERIES = {
    "series_id": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'FEDFUNDS' WHEN '2' THEN 'UNRATE' "
                 "WHEN '3' THEN 'CPIAUCSL' WHEN '4' THEN 'GDPC1' ELSE 'OTHER' END",
    "observation_date": "CAST(o_orderdate AS DATE)",
    "value": "CAST(o_totalprice AS DECIMAL(15,4))",
}

SCORED = {
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "(l_quantity + 100.0 * l_discount + 100.0 * l_tax) / 70.0",
    "fine_score": "l_extendedprice / 105000.0",
    "shipped": "CAST(l_shipdate AS DATE)",
    "returnflag": "l_returnflag",
    "linestatus": "l_linestatus",
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "moving": "l_extendedprice + CASE WHEN CAST(l_shipdate AS DATE) >= DATE '1998-07-01' THEN 30000.0 ELSE 0.0 END",
}
DRIFT_FEATURES = ["quantity", "price", "discount", "tax", "moving"]
DRIFT_CUTOFF = "1998-06-30"

SURVIVAL = {
    "issue_d": "CAST(o_orderdate AS DATE)",
    "last_pymnt_date": "CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END",
    "term_months": "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 60 ELSE 36 END",
    "is_default": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END",
    "quantity": "l_quantity",
    "tax": "l_tax",
    "discount": "l_discount",
    "score": "l_quantity",
    "surv_6": "1.0 - l_discount * 6 / 6.0",
    "surv_12": "1.0 - l_discount * 12 / 6.0",
    "surv_24": "1.0 - l_discount * 24 / 6.0",
}
HORIZONS = {6.0: "surv_6", 12.0: "surv_12", 24.0: "surv_24"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def loads(spark: SparkSession, sf_dir: str, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """Raw loan loads: several per loan.  Joins plan themselves by size (nation is 25 rows).

    ``turn`` (i, n) gives the i-th of n shares, by loan, for results that are written share by share.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    at, turns = turn
    if turns > 1:
        li, o = (df.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(turns)) == at)
                 for df, key in ((li, "l_orderkey"), (o, "o_orderkey")))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    people = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    # customers join before the line items, so the order key partitioning of the large join is
    # what the dedup by loan needs next
    wide = o.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return _select(li.join(wide, F.col("l_orderkey") == F.col("o_orderkey")), LOADS)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), SERIES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), SCORED)


def survival_input(spark: SparkSession, sf_dir: str, keys: dict[str, str] | None = None) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return _select(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), {**SURVIVAL, **(keys or {})})


def plain(df: DataFrame) -> DataFrame:
    """Output types every client compares alike: decimals as double, dates as text, flags as 0/1."""
    def out(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind == "float":
            return c.cast("double").alias(name)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return c.cast("string").alias(name)
        if kind == "boolean":
            return c.cast("int").alias(name)
        return c

    return df.select(*[out(n, k) for n, k in df.dtypes])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``plain`` with doubles rounded, so that summation order does not show."""
    df = plain(df)
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])
