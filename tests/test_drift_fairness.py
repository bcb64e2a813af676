import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators import fairness as FA


def col(spark, **values):
    names = list(values)
    return spark.createDataFrame([tuple(float(x) for x in row) for row in zip(*values.values())],
                                 ", ".join(f"{n} double" for n in names))


def numpy_psi(e, a, bins=10):
    edges = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1)))
    if len(edges) < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    es = np.clip(np.histogram(e, edges)[0] / len(e), 1e-6, None)
    as_ = np.clip(np.histogram(a, edges)[0] / len(a), 1e-6, None)
    return float(np.sum((as_ - es) * np.log(as_ / es)))


def numpy_ks(a, b):
    x = np.unique(np.r_[a, b])
    return max(abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)))


@pytest.mark.parametrize("shift,digits", [(0.0, 6), (3.0, 6), (0.4, 0)])
def test_against_numpy(spark, shift, digits):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=3000), digits), np.round(rng.normal(size=2500) + shift, digits)
    r = D.detect_drift(col(spark, x=a), col(spark, x=b), ["x", "absent"]).collect()
    assert len(r) == 1
    assert r[0]["psi"] == pytest.approx(numpy_psi(a, b), abs=1e-9)
    assert r[0]["ks_statistic"] == pytest.approx(numpy_ks(a, b), abs=1e-12)
    assert r[0]["drifted"] == (numpy_psi(a, b) >= 0.25)


def test_constant_and_empty(spark):
    one = col(spark, x=[1.0] * 100)
    r = D.detect_drift(one, one, ["x"]).first()
    assert r["psi"] == 0.0 and r["ks_statistic"] == 0.0 and not r["drifted"]
    r = D.detect_drift(one, one.where("x > 5"), ["x"]).first()
    assert r["ks_statistic"] == 0.0


def test_one_shifted_of_two(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    ref, cur = col(spark, stable=a, shifted=b), col(spark, stable=a[::-1], shifted=b + 4)
    report = D.detect_drift(ref, cur, ["stable", "shifted"])
    assert {r["feature"]: r["drifted"] for r in report.collect()} == {"stable": False, "shifted": True}
    s = D.drift_summary(report).first()
    assert (s["n_features"], s["n_drifted"], s["drift_share"], s["dataset_drift"]) == (2, 1, 0.5, True)


def test_nulls_are_ignored(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    assert D.detect_drift(ref, ref, ["x"]).first()["psi"] == pytest.approx(0.0)
    assert D.null_shares(ref, ref, ["x"]).first()["ref_null_share"] == pytest.approx(1 / 101)


def people(spark, rows):
    return spark.createDataFrame(rows, "home string, y int, p int")


def test_fair_groups(spark):
    rows = [(g, y, y) for g in ("MORTGAGE", "RENT") for y in [0] * 80 + [1] * 20]
    r = FA.fairness_metrics(people(spark, rows), "y", "p", {"home": ["MORTGAGE"]}).first()
    assert r["disparate_impact_ratio"] == pytest.approx(1.0)
    assert r["statistical_parity_difference"] == 0.0 and r["equal_opportunity_difference"] == 0.0
    assert r["di_within_policy"]


def test_biased_groups_and_verdict(spark):
    rows = [("MORTGAGE", 0, 0)] * 100 + [("RENT", 0, 1)] * 90 + [("RENT", 0, 0)] * 10
    df = people(spark, rows).withColumn("other", F.lit("a"))
    report = FA.audit(df, "y", "p", {"home": ["MORTGAGE"], "other": ["a"]}, "m").collect()
    by = {r["attribute"]: r for r in report}
    assert by["home"]["disparate_impact_ratio"] == pytest.approx(0.1)
    assert by["home"]["statistical_parity_difference"] == pytest.approx(-0.9)
    # nobody is unprivileged: the ratio is unknown and fails
    assert by["other"]["disparate_impact_ratio"] is None and not by["other"]["di_within_policy"]
    assert not by["home"]["overall_pass"]


@pytest.mark.parametrize("di,ok", [(1.0, True), (0.8, True), (1.25, True), (0.79, False), (1.26, False),
                                   (math.nan, False), (math.inf, False), (None, False)])
def test_policy_band(spark, di, ok):
    df = spark.createDataFrame([(di,)], "di double")
    assert df.select(FA.within_policy(F.col("di"))).first()[0] is ok
