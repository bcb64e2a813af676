"""Distribution drift of numeric features between a reference and a current frame.

Both frames fold into one (feature, value, n_ref, n_cur) table; quantile edges, bin shares and the
KS distance all come from that table, so each input is scanned and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import interpolated, order_statistics, running_sums, sorted_position
from riskframe.operators.prep import long_values
from riskframe.session import cut_lineage

# fixed values: share floor and alert thresholds
SHARE_FLOOR = 1e-6
PSI_THRESHOLD = 0.25
KS_THRESHOLD = 0.2


def shared_features(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> list[str]:
    """Features found on both sides; the others are skipped."""
    return [f for f in features if f in ref.columns and f in cur.columns]


def two_sided_counts(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur); missing values are left out on both sides."""
    cols = shared_features(ref, cur, features)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = long_values(ref, cols, n_ref=one, n_cur=zero).unionByName(long_values(cur, cols, n_ref=zero, n_cur=one))
    return both.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def feature_profile(counts: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, t_ref, t_cur, ks_statistic, n_edges, inner): one aggregate over running counts.

    ``inner`` holds the distinct reference quantiles without the two ends.
    """
    cum = running_sums(counts, "value", {"n_ref": "c_ref", "n_cur": "c_cur"}, by=["feature"], shared_bounds=False,
                       totals={"n_ref": "t_ref", "n_cur": "t_cur"})
    probs = [i / bins for i in range(bins + 1)]
    both = (F.col("t_ref") > 0) & (F.col("t_cur") > 0)
    gap = F.when(both, F.abs(F.col("c_ref") / F.col("t_ref") - F.col("c_cur") / F.col("t_cur")))
    found = cum.groupBy("feature").agg(
        F.max("t_ref").alias("t_ref"), F.max("t_cur").alias("t_cur"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks_statistic"),
        *order_statistics("value", "n_ref", "c_ref", "t_ref", probs))
    known = F.filter(interpolated("t_ref", probs), lambda x: x.isNotNull())
    edges = F.array_distinct(F.array_sort(known))
    shaped = found.select("feature", "t_ref", "t_cur", "ks_statistic", edges.alias("e"))
    return shaped.select(
        "feature", "t_ref", "t_cur", "ks_statistic", F.size("e").alias("n_edges"),
        F.when(F.size("e") > 2, F.slice("e", F.lit(2), F.size("e") - 2))
        .otherwise(F.array().cast("array<double>")).alias("inner"))


def psi_from_profile(counts: DataFrame, profile: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, ks_statistic, psi): [lo, hi) reference-quantile bins with open outer ends.

    The profile has one row per feature, which bounds the broadcast.
    """
    joined = counts.join(F.broadcast(profile), "feature", "inner")
    placed = sorted_position(joined, F.col("inner"), F.col("value"), bins, "bin", inclusive=True)
    binned = placed.groupBy("feature", "bin", "n_edges", "t_ref", "t_cur", "ks_statistic").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    floor = F.lit(SHARE_FLOOR)
    e = F.greatest(F.col("n_ref") / F.greatest("t_ref", F.lit(1)), floor)
    a = F.greatest(F.col("n_cur") / F.greatest("t_cur", F.lit(1)), floor)
    term = F.when(F.col("n_edges") >= 2, (a - e) * F.log(a / e)).otherwise(0.0)
    return binned.groupBy("feature").agg(F.max("ks_statistic").alias("ks_statistic"), F.sum(term).alias("psi"))


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature; 0.0 when the reference has a single value."""
    counts = cut_lineage(two_sided_counts(ref, cur, features))
    return psi_from_profile(counts, feature_profile(counts, bins), bins).select("feature", "psi")


def ks_two_sample(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample KS distance per feature; 0.0 when a side is empty."""
    return feature_profile(two_sided_counts(ref, cur, features)).select("feature", "ks_statistic")


def detect_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str],
                 threshold: float = PSI_THRESHOLD, bins: int = 10) -> DataFrame:
    """(feature, psi, ks_statistic, drifted) for every feature found on both sides.

    The counts are written once: the inputs are scanned a single time however many features and
    statistics there are.
    """
    cols = shared_features(ref, cur, features)
    counts = cut_lineage(two_sided_counts(ref, cur, cols))
    found = psi_from_profile(counts, feature_profile(counts, bins), bins)
    names = ref.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    value = F.coalesce("psi", F.lit(0.0))
    return names.join(found, "feature", "left").select(
        "feature", value.alias("psi"), F.coalesce("ks_statistic", F.lit(0.0)).alias("ks_statistic"),
        (value >= threshold).alias("drifted"))


def drift_summary(report: DataFrame) -> DataFrame:
    """(n_features, n_drifted, drift_share, dataset_drift) of a feature report."""
    return report.agg(
        F.count(F.lit(1)).cast("int").alias("n_features"), F.count_if("drifted").cast("int").alias("n_drifted"),
        F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0)).alias("drift_share"),
        F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("dataset_drift"))


def null_shares(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, ref_null_share, cur_null_share): how much each side leaves out."""
    cols = shared_features(ref, cur, features)

    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in cols])))

    return side(ref, "ref_null_share").join(side(cur, "cur_null_share"), "feature")
