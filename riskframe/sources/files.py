"""Landed files: loan CSV, macro series, nested filing frames, Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskframe import schemas as S

FRAME_PAYLOAD = ("struct<data:array<struct<accn:string,cik:bigint,entityName:string,loc:string,"
                 "`end`:string,val:decimal(24,4)>>>")
CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """Loan CSV, columns found by header name, as text (typed by ``clean_loans``).

    The header gives the order; unknown columns are left out, absent optional ones are NULL, an absent
    required one is an error, as is a file whose header differs from the first one's.  Doubled quotes
    stand for a quote.  Lines that do not parse keep their text in ``_corrupt``.  ``multi_line`` allows
    line breaks inside quotes, at the price of one task per file.
    """
    names = list(columns or [S.CSV_RENAMES.get(n, n) for n, _ in S.RAW_LOAN_FIELDS if n != "loaded_at"])
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    absent = [c for c in S.CSV_REQUIRED if c in names and c not in header]
    if absent:
        raise ValueError(f"the CSV header lacks {absent}")
    text = StructType([StructField(n, StringType()) for n in [*header, CORRUPT]])
    # whole lines are parsed: with fewer columns the parser overlooks surplus fields
    lines = spark.read.schema(text).options(
        **options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False,
        columnPruning=False).csv(path)
    known = [F.col(f"`{n}`") if n in header else F.lit(None).cast("string").alias(n) for n in names]
    return lines.select(*known, CORRUPT)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with all the named columns present."""
    return df.na.drop(subset=list(cols))


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_date(source: Column) -> Column:
    """First day of a month written as ``S.CSV_DATE_FORMAT``.

    Plainly written months are taken apart; whatever else the format allows takes the dearer parser.
    """
    month = ((F.instr(F.lit("".join(MONTHS)), F.substring(source, 1, 3)) + 2) / 3).cast("int")
    day = F.make_date(F.substring(source, 5, 4).cast("int"), month, F.lit(1))
    plain = source.rlike(f"^({'|'.join(MONTHS)})-[1-9][0-9]{{3}}$")
    return F.when(plain, day).otherwise(F.try_to_date(source, S.CSV_DATE_FORMAT))


def clean_loans(df: DataFrame) -> DataFrame:
    """Typed loan rows from CSV text: dates, numbers, NULL and zero defaults, table names.

    Unparseable values become NULL; broken lines and rows without a usable id are left to
    ``rejected_loans``.
    """
    if CORRUPT in df.columns:
        df = df.where(F.col(CORRUPT).isNull())
    df = require(df, S.CSV_REQUIRED)
    out = []
    for name, kind in S.RAW_LOAN_FIELDS:
        if name == "loaded_at":
            continue
        source = F.col(S.CSV_RENAMES.get(name, name))
        if kind == "date":
            # the first character tells the format: a failed parse is much dearer than this test
            value = F.when(source.rlike("^[0-9]"), F.try_to_date(source, "yyyy-MM-dd")).otherwise(month_date(source))
        elif kind in ("int", "bigint"):
            # most integers are written plainly; "5.0" takes the slower decimal route
            value = F.coalesce(source.try_cast(kind), source.try_cast("decimal(38,4)").try_cast(kind))
        elif kind == "string":
            value = source
        else:
            value = source.try_cast(kind)
        if name in S.NULL_TO_ZERO:
            value = F.coalesce(value, F.lit(0).cast(kind))
        if name == "dti":
            value = F.when(value >= 0, value)
        out.append(value.alias(name))
    return df.select(*out).where(F.col("loan_id").isNotNull())


def rejected_loans(df: DataFrame) -> DataFrame:
    """Lines that cannot be loaded: missing required fields, a non-numeric id, broken CSV."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in S.CSV_REQUIRED])
    bad_id = F.col("id").try_cast("decimal(38,4)").try_cast("bigint").isNull()
    reason = (F.when(missing, "missing required field").when(bad_id, "id is not a number")
              .when(F.col(CORRUPT).isNotNull(), "broken line"))
    return df.withColumn("reason", reason).where("reason is not null")


def read_series(df: DataFrame, names: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long series rows: known series only, missing observations dropped, display name added.

    ``keep`` names further columns to carry along.
    """
    names = names or S.SERIES_NAMES
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    value = F.col("value").cast("double")
    known = F.col("series_id").isin(*names) & value.isNotNull() & ~F.isnan(value)
    return df.where(known).select(
        "series_id", F.col("observation_date").cast("date").alias("observation_date"),
        F.col("value").cast("decimal(15,4)").alias("value"),
        label[F.col("series_id")].alias("series_name"), *keep)


def flatten_frames(df: DataFrame, payload: str = "payload", tag: str = "tag",
                   uom: str = "uom") -> DataFrame:
    """One row per fact of nested filing frames; empty payloads give no rows.

    ``df`` carries the JSON text plus the tag and unit it was requested for.
    """
    parsed = df.select(F.col(tag).alias("tag"), F.col(uom).alias("uom"),
                       F.from_json(F.col(payload), FRAME_PAYLOAD).alias("f"))
    facts = parsed.select("tag", "uom", F.inline("f.data"))
    return facts.select(
        F.col("accn").alias("adsh"), "cik", F.col("entityName").alias("company_name"),
        F.lit(None).cast("string").alias("form_type"),
        F.try_to_date("end", "yyyy-MM-dd").alias("period"),
        F.lit(None).cast("int").alias("fy"), F.lit(None).cast("string").alias("fp"),
        "tag", F.col("val").cast("decimal(24,4)").alias("value"), "uom",
    ).where("adsh is not null and tag is not null")


def union_frames(dfs: Sequence[DataFrame], spark: SparkSession | None = None,
                 fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """Stack frames by name, absent columns as NULL; no frames gives an empty frame."""
    if not dfs:
        if spark is None:
            raise ValueError("an empty union needs a session")
        return spark.createDataFrame([], S.ddl(fields or S.FILING_FIELDS))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; callers select columns, the scan prunes the rest."""
    return spark.read.parquet(path)
