"""Binary-classification metrics from one score curve.

The frame is first reduced to one row per distinct score; running sums over descending scores give
the confusion counts at every threshold.  Because the previous point of the curve is the running
sum minus the row's own count, areas need no neighbour lookup and every metric is a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import bin_left_closed, bin_right_closed, unit_edges
from riskframe.operators.ordered import running_sums


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score; rows without label or score are left out."""
    y, s = F.col(label), F.col(score).cast("double")
    rows = df.select(s.alias("score"), y.cast("int").alias("y")).where("score is not null and y is not null")
    return rows.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"),
                                     F.count_if(F.col("y") == 0).alias("neg"))


def score_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score: counts at the score, tp / fp at or above it, rates, precision."""
    counts = score_counts(df, label, score)
    return with_rates(running_sums(counts, "score", {"pos": "tp", "neg": "fp"}, descending=True,
                                   totals={"pos": "p", "neg": "n"}))


def with_rates(curve: DataFrame) -> DataFrame:
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    ptp, pfp = tp - F.col("pos"), fp - F.col("neg")

    # no positives: recall is 1 at every threshold; no negatives: the false positive rate is unknown
    def recall(x: Column) -> Column:
        return F.when(p > 0, x / p).otherwise(1.0)

    return curve.withColumns({
        "tpr": F.when(p > 0, tp / p), "fpr": F.when(n > 0, fp / n),
        "precision": tp / (tp + fp), "recall": recall(tp),
        "prev_precision": F.when(ptp + pfp > 0, ptp / (ptp + pfp)).otherwise(1.0),
        "prev_recall": F.when(ptp + pfp > 0, recall(ptp)).otherwise(0.0),
    })


def _roc_part() -> Column:
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    return F.sum(area.cast("double"))


def _pr_part() -> Column:
    step = F.col("recall") - F.col("prev_recall")
    return F.sum(step * (F.col("precision") + F.col("prev_precision")) / 2.0)


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area with ties averaged; NULL when a class is missing."""
    agg = curve.agg(_roc_part().alias("a"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    return agg.select(F.when(both, F.col("a") / (p * n)).alias("roc_auc"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid over (recall, precision) starting at recall 0, precision 1."""
    return curve.agg(_pr_part().alias("pr_auc"))


def recall_at_precision(curve: DataFrame, precision: float = 0.80, out: str = "recall_at_p80") -> DataFrame:
    return curve.agg(F.coalesce(
        F.max(F.when(F.col("precision") >= precision, F.col("recall"))), F.lit(0.0)).alias(out))


def ks_by_label(curve: DataFrame) -> DataFrame:
    """Largest distance of the two class score distributions; 0.0 when a class is empty."""
    return curve.agg(F.coalesce(F.max(F.abs(F.col("tpr") - F.col("fpr"))), F.lit(0.0)).alias("ks_statistic"))


def _best_point() -> Column:
    """Point of greatest tpr - fpr, the highest score among equals."""
    return F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "score", "tp", "fp"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Youden threshold; infinity when no point beats predicting nothing."""
    best = curve.where("tpr is not null and fpr is not null").agg(_best_point().alias("b"))
    return best.select(F.when(F.col("b.j") > 0, F.col("b.score")).when(
        F.col("b").isNotNull(), F.lit(float("inf"))).alias("best_threshold"))


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Counts at a threshold, predicted positive at or above it."""
    y, hit = F.col(label), F.col(score) >= F.lit(threshold)
    return df.agg(F.count_if((y == 0) & ~hit).alias("tn"), F.count_if((y == 0) & hit).alias("fp"),
                  F.count_if((y == 1) & ~hit).alias("fn"), F.count_if((y == 1) & hit).alias("tp"))


def _count_sums() -> list[Column]:
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    return [F.sum(pos).alias("__pos"), F.sum(pos + neg).alias("__rows"),
            F.sum(s * (pos + neg)).alias("__score"),
            F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("__sq")]


def _calibration_columns() -> list[Column]:
    gap = F.abs(F.col("__pos") / F.col("__rows") - F.col("__score") / F.col("__rows"))
    weight = F.col("__rows")
    inside = F.col("__bin").isNotNull()
    return [(F.sum("__sq") / F.sum("__rows")).alias("brier_score"),
            (F.coalesce(F.sum(F.when(inside, gap * weight)), F.lit(0.0)) / F.sum("__rows")).alias("ece")]


def calibration(df: DataFrame, n_bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Brier score and expected calibration error over [lo, hi) bins, the last one closed."""
    counts = score_counts(df, label, score).withColumn("__bin", bin_left_closed("score", n_bins))
    return counts.groupBy("__bin").agg(*_count_sums()).agg(*_calibration_columns())


def extended_metrics(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10) -> DataFrame:
    """All metrics as one row, from one curve: areas, KS, threshold, confusion there, calibration."""
    curve = score_curve(df, label, score).withColumn("__bin", bin_left_closed("score", n_bins))
    gap = F.abs(F.col("tpr") - F.col("fpr"))
    by_bin = curve.groupBy("__bin").agg(
        *_count_sums(), F.max("p").alias("p"), F.max("n").alias("n"),
        _roc_part().alias("__roc"), _pr_part().alias("__pr"), F.max(gap).alias("__ks"),
        F.max(F.when(F.col("precision") >= 0.80, F.col("recall"))).alias("__rec"),
        _best_point().alias("__best"))
    one = by_bin.agg(
        *_calibration_columns(), F.max("p").alias("p"), F.max("n").alias("n"),
        F.sum("__roc").alias("roc"), F.sum("__pr").alias("pr"), F.max("__ks").alias("ks"),
        F.max("__rec").alias("rec"), F.max("__best").alias("b"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    found = both & (F.col("b.j") > 0)
    tp = F.when(found, F.col("b.tp")).otherwise(0)
    fp = F.when(found, F.col("b.fp")).otherwise(0)
    return one.select(
        F.col("pr").alias("pr_auc"),
        F.when(both, F.col("roc") / (F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        F.coalesce("rec", F.lit(0.0)).alias("recall_at_p80"),
        F.coalesce("ks", F.lit(0.0)).alias("ks_statistic"),
        F.when(found, F.col("b.score")).when(both, F.lit(float("inf"))).alias("best_threshold"),
        F.struct((F.col("n") - fp).alias("tn"), fp.alias("fp"), (F.col("p") - tp).alias("fn"),
                 tp.alias("tp")).alias("confusion_matrix"),
        "brier_score", "ece")


def score_histogram(df: DataFrame, bins: int = 20, score: str = "score") -> DataFrame:
    """Equal bins on [0, 1], the last closed; out-of-range scores left out, empty bins kept."""
    edges = unit_edges(bins)
    frame = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, bin_lo double, bin_hi double")
    counts = df.groupBy(bin_left_closed(score, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "bin", "left").select(
        "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("count"))


def calibration_curve(df: DataFrame, n_bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Reliability points over (lo, hi] bins, empty bins left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    binned = rows.groupBy(bin_right_closed(score, n_bins).alias("bin")).agg(
        F.avg(score).alias("prob_pred"), F.avg(F.col(label).cast("double")).alias("prob_true"),
        F.count(F.lit(1)).alias("n"))
    return binned.where("bin is not null")


def roc_points(curve: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the origin at infinity."""
    points = curve.select(F.col("score").alias("threshold"), "fpr", "tpr")
    start = curve.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(curve: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, plus the (1, 0) anchor."""
    points = curve.select(F.col("score").alias("threshold"), "precision", "recall")
    start = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(start)


# fixed value: lowest acceptable PR-AUC
PR_AUC_MIN = 0.25


def passes_gate(metrics: DataFrame, minimum: float = PR_AUC_MIN) -> DataFrame:
    """Gate flag on a metric row; a missing value counts as 0."""
    value = F.coalesce(F.col("pr_auc"), F.lit(0.0)) if "pr_auc" in metrics.columns else F.lit(0.0)
    return metrics.select((value >= minimum).alias("passed"))
