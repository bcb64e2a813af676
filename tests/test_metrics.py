import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators import monitor as P

SCORES_8 = ([0, 0, 0, 0, 1, 1, 1, 1], [.05, .1, .2, .3, .7, .8, .9, .95])


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double")


def brute(y, p):
    """Metrics straight from their definitions."""
    y, p = np.asarray(y), np.asarray(p, float)
    ts = np.unique(p)[::-1]
    tp = np.array([((p >= t) & (y == 1)).sum() for t in ts])
    fp = np.array([((p >= t) & (y == 0)).sum() for t in ts])
    P_, N = (y == 1).sum(), (y == 0).sum()
    tpr, fpr, prec = tp / P_, fp / N, tp / (tp + fp)
    roc = np.trapezoid(np.r_[0, tpr], np.r_[0, fpr])
    pr = np.trapezoid(np.r_[1, prec], np.r_[0, tpr])
    ks = max(abs(tpr - fpr))
    best = ts[np.argmax(tpr - fpr)]
    edges = np.linspace(0, 1, 11)
    ece = 0
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (p >= lo) & ((p < hi) if hi < 1 else (p <= hi))
        if m.any():
            ece += abs(y[m].mean() - p[m].mean()) * m.mean()
    rec = tpr[prec >= 0.8]
    return dict(roc_auc=roc, pr_auc=pr, ks_statistic=ks, best_threshold=best, brier_score=((p - y) ** 2).mean(),
                ece=ece, recall_at_p80=rec.max() if len(rec) else 0.0)


@pytest.mark.parametrize("seed,digits", [(0, 1), (1, 2), (2, 6)])
def test_extended_metrics_brute_force(spark, seed, digits):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 700)
    p = np.round(np.clip(0.3 * y + rng.random(700) * 0.7, 0, 1), digits)
    got = M.extended_metrics(frame(spark, y, p)).first().asDict()
    for name, want in brute(y, p).items():
        assert got[name] == pytest.approx(want, abs=1e-12), name


def test_separable(spark):
    got = M.extended_metrics(frame(spark, *SCORES_8)).first()
    assert 0.3 < got["best_threshold"] <= 0.7
    assert got["confusion_matrix"].asDict() == {"tn": 4, "fp": 0, "fn": 0, "tp": 4}
    assert M.confusion(frame(spark, *SCORES_8), 0.5).first().asDict() == {"tn": 4, "fp": 0, "fn": 0, "tp": 4}


def test_pr_auc_with_ties(spark):
    df = frame(spark, [1, 0, 1, 0, 1], [.9, .9, .5, .4, .3])
    assert M.pr_auc(M.score_curve(df)).first()[0] == pytest.approx(0.6277777777777778)


def test_single_class_and_empty(spark):
    one = M.extended_metrics(frame(spark, [1, 1], [.2, .8])).first()
    assert one["roc_auc"] is None and one["ks_statistic"] == 0.0 and one["best_threshold"] is None
    none = M.extended_metrics(frame(spark, [0, 0], [.2, .8])).first()
    assert none["pr_auc"] == pytest.approx(0.5) and none["recall_at_p80"] == 0.0
    empty = M.extended_metrics(frame(spark, [], [])).first()
    assert empty["roc_auc"] is None and empty["brier_score"] is None


def test_threshold_is_infinite_when_nothing_helps(spark):
    df = frame(spark, [0, 1], [.9, .1])
    assert M.best_threshold(M.score_curve(df)).first()[0] == math.inf
    assert M.extended_metrics(df).first()["best_threshold"] == math.inf


def test_reversed_scores(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    a = M.roc_auc(M.score_curve(frame(spark, y, p))).first()[0]
    b = M.roc_auc(M.score_curve(frame(spark, y, 1 - p))).first()[0]
    assert a + b == pytest.approx(1.0)


def test_histogram(spark):
    rows = M.score_histogram(frame(spark, [0, 1, 1], [.05, .5, .95]), 10).orderBy("bin_lo").collect()
    assert len(rows) == 10 and rows[0]["bin_lo"] == 0.0 and rows[-1]["bin_hi"] == 1.0
    assert sum(r["count"] for r in rows) == 3
    p = [0.0, .3, .6, .7, 1.0, 1.5, -.1]
    counts = [r["count"] for r in M.score_histogram(frame(spark, [0] * 7, p), 20).orderBy("bin_lo").collect()]
    assert counts == list(np.histogram(p, bins=20, range=(0, 1))[0])


def test_reliability_bins_are_right_closed(spark):
    rows = M.calibration_curve(frame(spark, [0, 1, 1], [0.0, 0.1, 0.2])).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2), (1, 1)]


@pytest.mark.parametrize("value,passed", [(0.25, True), (0.30, True), (0.20, False), (None, False)])
def test_gate(spark, value, passed):
    df = spark.createDataFrame([(value,)], "pr_auc double")
    assert M.passes_gate(df, 0.25).first()[0] is passed
    assert M.passes_gate(spark.createDataFrame([(1,)], "other int")).first()[0] is False


def test_flatten(spark):
    m = spark.range(1).select(
        F.lit(.4).alias("pr_auc"), F.lit(True).alias("flag"), F.lit("x").alias("name"),
        F.struct(F.lit(10).alias("tn"), F.lit(2).alias("fp"), F.lit(3).alias("fn"), F.lit(5).alias("tp"))
        .alias("confusion_matrix"), F.lit(.12).alias("brier_score"))
    got = {r["metric"]: r["value"] for r in P.flatten_metrics(m).collect()}
    assert got == {"pr_auc": .4, "brier_score": .12, "cm_tn": 10, "cm_fp": 2, "cm_fn": 3, "cm_tp": 5}
