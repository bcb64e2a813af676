"""Data-quality rules: one-pass summary, violation rows, and the gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(cols: Sequence[str]) -> dict[str, Column]:
    """Failure conditions by rule name."""
    return {f"not_null_{c}": F.col(c).isNull() for c in cols}


def accepted_values(col: str, values: Sequence) -> dict[str, Column]:
    """NULL passes."""
    return {f"accepted_{col}": F.coalesce(~F.col(col).isin(*values), F.lit(False))}


def row_checks(checks: dict[str, str]) -> dict[str, Column]:
    """SQL conditions that must not be false; an unknown (NULL) condition passes."""
    return {f"check_{name}": F.coalesce(~F.expr(sql), F.lit(False)) for name, sql in checks.items()}


def row_rule_summary(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one scan: (rule, n_rows, n_failed, passed)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(cond).alias(name) for name, cond in rules.items()])
    table = F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col("n").alias("n_rows"), F.col(name).alias("n_failed"))
        for name in rules]))
    return one.select(table).withColumn("passed", F.col("n_failed") == 0)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; keys with a NULL part are ignored."""
    present = df.select(*keys).na.drop(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def unique_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule row counting the repeated keys."""
    counts = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(complete & (F.col("n") > 1)).alias("n_failed"),
    ).select(F.lit("unique_" + "_".join(keys)).alias("rule"), "n_rows", "n_failed",
             (F.col("n_failed") == 0).alias("passed"))


def quality_summary(df: DataFrame, rules: dict[str, Column], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """One row per rule; one scan for row rules, one partial aggregate per unique key."""
    parts = [row_rule_summary(df, rules)] if rules else []
    parts += [unique_summary(df, keys) for keys in unique]
    return reduce(lambda a, b: a.unionByName(b), parts)


def quality_violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """Failing rows as (rule, key), from one scan."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]),
                    lambda x: x.isNotNull())
    return df.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("key"))


class QualityError(RuntimeError):
    """A rule failed, so the run stops before anything is published."""


def assert_quality(summary: DataFrame) -> None:
    """Raise naming the failed rules; the summary has one row per rule."""
    failed = summary.where(~F.col("passed")).select("rule", "n_failed").collect()
    if failed:
        raise QualityError("; ".join(f"{r.rule}: {r.n_failed}" for r in failed))
