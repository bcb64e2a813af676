"""Group fairness of binary decisions; the favourable outcome is label 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import binarize

# fixed values: policy band of the disparate impact ratio
DI_LOWER, DI_UPPER = 0.8, 1.25


def within_policy(di: Column) -> Column:
    """Inside the band; a missing or non-finite ratio fails."""
    return F.coalesce(di.between(DI_LOWER, DI_UPPER), F.lit(False))


def fairness_metrics(df: DataFrame, y: str, yhat: str, attributes: dict[str, Sequence]) -> DataFrame:
    """One row per protected attribute: disparate impact, parity and opportunity differences.

    All attributes are conditional counts of a single scan, so group sizes do not matter.
    """
    good = F.col(yhat) == 0
    truly_good = F.col(y) == 0
    aggs = []
    for i, (attr, values) in enumerate(attributes.items()):
        priv = binarize(attr, values) == 1
        for side, group in (("p", priv), ("u", ~priv)):
            aggs += [F.count_if(group).alias(f"{side}n{i}"),
                     F.count_if(group & good).alias(f"{side}g{i}"),
                     F.count_if(group & truly_good).alias(f"{side}t{i}"),
                     F.count_if(group & truly_good & good).alias(f"{side}tg{i}")]
    one = df.agg(*aggs)

    def rate(side: str, num: str, den: str, i: int) -> Column:
        return F.try_divide(F.col(f"{side}{num}{i}").cast("double"), F.col(f"{side}{den}{i}").cast("double"))

    rows = []
    for i, attr in enumerate(attributes):
        u, p = rate("u", "g", "n", i), rate("p", "g", "n", i)
        rows.append(F.struct(
            F.lit(attr).alias("attribute"), F.col(f"pn{i}").alias("n_privileged"),
            F.col(f"un{i}").alias("n_unprivileged"),
            F.try_divide(u, p).alias("disparate_impact_ratio"),
            (u - p).alias("statistical_parity_difference"),
            (rate("u", "tg", "t", i) - rate("p", "tg", "t", i)).alias("equal_opportunity_difference")))
    table = one.select(F.inline(F.array(*rows)))
    return table.withColumn("di_within_policy", within_policy(F.col("disparate_impact_ratio")))


def audit(df: DataFrame, y: str, yhat: str, attributes: dict[str, Sequence],
          model_name: str = "model") -> DataFrame:
    """Fairness rows with the overall verdict on each (all attributes must pass)."""
    report = fairness_metrics(df, y, yhat, attributes)
    verdict = report.agg(F.bool_and("di_within_policy")).scalar()
    return report.withColumns({"model_name": F.lit(model_name), "overall_pass": verdict})
