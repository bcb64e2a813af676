"""Monthly series: pivot, lags, growth, month spine, join to facts by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.scalar import month_start, safe_growth


def pivot_series(df: DataFrame, on: str, key: str, value: str, mapping: dict[str, str]) -> DataFrame:
    """Named series as columns: one conditional-max aggregate, one shuffle on ``on``."""
    return df.groupBy(on).agg(
        *[F.max(F.when(F.col(key) == k, F.col(value))).alias(name) for k, name in mapping.items()])


def _row_order(order: str, partition: Sequence[str] = ()):
    # without a partition the frame must be one row per calendar period, which is a bounded table
    return Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order)


def lag_diff(df: DataFrame, order: str, col: str, n: int, out: str,
             partition: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(out, F.col(col) - F.lag(col, n).over(_row_order(order, partition)))


def lag_growth(df: DataFrame, order: str, col: str, n: int, out: str, scale: int = 4,
               partition: Sequence[str] = ()) -> DataFrame:
    prev = F.lag(col, n).over(_row_order(order, partition))
    return df.withColumn(out, safe_growth(F.col(col), prev, scale))


def add_lags(df: DataFrame, order: str, lags: dict[str, tuple[str, int]],
             partition: Sequence[str] = ()) -> DataFrame:
    """``lags`` maps output column -> (input column, rows back)."""
    w = _row_order(order, partition)
    return df.select("*", *[F.lag(c, n).over(w).alias(out) for out, (c, n) in lags.items()])


def month_spine(df: DataFrame, month: str) -> DataFrame:
    """Every month between the first and the last one present (gaps filled with NULL rows)."""
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(month))
    return months.join(df, month, "left")


def forward_fill(df: DataFrame, order: str, cols: Sequence[str],
                 partition: Sequence[str] = ()) -> DataFrame:
    w = _row_order(order, partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def join_context(facts: DataFrame, context: DataFrame, fact_date: str, context_month: str,
                 cols: Sequence[str]) -> DataFrame:
    """Add monthly context columns to facts, all facts kept.

    The context has one row per calendar month (at most 12 x 9999 rows for any DATE), which bounds
    the broadcast; facts are not shuffled.
    """
    month = "__month"
    side = context.select(F.col(context_month).alias(month), *cols)
    joined = facts.withColumn(month, month_start(fact_date)).join(F.broadcast(side), month, "left")
    return joined.select(*facts.columns, *cols)
