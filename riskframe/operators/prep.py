"""Feature preparation: median imputation, category codes, temporal split, column selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions.scalar import to_number
from riskframe.operators.ordered import exact_quantiles, text_ranks

MISSING = "MISSING"
BROADCAST_ROWS = 200_000


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def long_values(df: DataFrame, cols: Sequence[str], name: str = "feature", **extra: Column) -> DataFrame:
    """(feature, value, extra...) rows of numeric columns; NULL and NaN left out."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), to_number(c).alias("value")) for c in present(df, cols)]))
    long = df.select(pairs).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.withColumns(extra) if extra else long


def value_counts(df: DataFrame, cols: Sequence[str], name: str = "feature") -> DataFrame:
    """(feature, value, n) of numeric columns, one row per distinct value."""
    return long_values(df, cols, name).groupBy(name, "value").agg(F.count(F.lit(1)).alias("n"))


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column as (feature, median); columns without a value give 0.0.

    Built on running counts over value ranges, so no task holds a column's distinct values.
    """
    cols = present(df, cols)
    q = exact_quantiles(value_counts(df, cols), "value", "n", [0.5], by=["feature"])
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(q, "feature", "left").select(
        "feature", F.coalesce(F.col("quantiles")[0], F.lit(0.0)).alias("median"))


@dataclass(frozen=True)
class Imputer:
    """Medians by column; a handful of numbers."""

    values: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(F.when(~F.isnan(to_number(c)), to_number(c)), F.lit(v))
            for c, v in self.values.items() if c in df.columns})


def fit_imputer(df: DataFrame, cols: Sequence[str] = tuple(S.NUMERICAL_FEATURES)) -> Imputer:
    return Imputer({r.feature: r["median"] for r in medians(df, cols).collect()})


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category, code): 0-based rank of distinct texts in order, NULL as ``MISSING``."""
    cols = present(df, cols)
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in cols]))
    return text_ranks(df.select(pairs), "feature", "category", "code")


@dataclass(frozen=True)
class CategoryCodes:
    """Code table; unseen categories become -1."""

    table: DataFrame
    columns: tuple[str, ...]
    n_rows: int

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace each column by its code: one join per column, broadcast only below a row limit."""
        small = self.n_rows <= BROADCAST_ROWS
        order = df.columns
        for c in present(df, self.columns):
            side = self.table.where(F.col("feature") == c).select(
                F.col("category").alias("__cat"), F.col("code").alias("__code"))
            df = df.withColumn("__cat", F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
            df = df.join(F.broadcast(side) if small else side, "__cat", "left").withColumn(c, F.coalesce("__code", F.lit(-1)))
            df = df.drop("__cat", "__code")
        return df.select(*order)


def fit_codes(df: DataFrame, cols: Sequence[str] = tuple(S.CATEGORICAL_FEATURES)) -> CategoryCodes:
    cols = present(df, cols)
    table = category_codes(df, cols)
    return CategoryCodes(table, tuple(cols), table.count())


def temporal_split(df: DataFrame, date_col: str = "issue_d", target: str = S.TARGET,
                   cutoff: str | date = S.SPLIT_DATE) -> tuple[DataFrame, DataFrame]:
    """(train, test): outcome known, dated up to / after the cutoff; undated rows fall in neither."""
    known = df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))
    day, limit = F.col(date_col).cast("date"), F.lit(str(cutoff)).cast("date")
    return known.where(day <= limit), known.where(day > limit)


def preprocess(df: DataFrame, fit_on: DataFrame | None = None,
               numeric: Sequence[str] = tuple(S.NUMERICAL_FEATURES),
               categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES)) -> DataFrame:
    """Impute and encode.  Fitting on the frame itself is the parity mode; pass the train split
    as ``fit_on`` to keep the test split out of medians and codes."""
    base = df if fit_on is None else fit_on
    return fit_codes(base, categorical).apply(fit_imputer(base, numeric).apply(df))


def prepare(df: DataFrame, features: Sequence[str] | None = None, target: str = S.TARGET,
            out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector of the columns that exist, plus the integer target as ``label``."""
    cols = present(df, features or S.NUMERICAL_FEATURES + S.CATEGORICAL_FEATURES)
    assembled = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
    label = [F.col(target).cast("int").alias("label")] if target in df.columns else []
    return assembled.select(*keep, out, *label)


def align_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns in order; names every missing one otherwise."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*expected)


__all__ = ["Imputer", "CategoryCodes", "align_features", "category_codes", "fit_codes",
           "fit_imputer", "medians", "prepare", "preprocess", "present", "temporal_split",
           "value_counts", "long_values"]
