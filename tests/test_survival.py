import datetime as dt
import math

import numpy as np
import pytest

from riskframe.operators import survival as V


def frame(spark, t, e, **extra):
    cols = {"duration_months": t, "event": e, **extra}
    rows = list(zip(*[[float(x) for x in v] for v in cols.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))


def numpy_km(t, hit):
    out, s = {}, 1.0
    for u in np.unique(t):
        s *= 1 - hit[t == u].sum() / (t >= u).sum()
        out[u] = s
    return out


def test_durations(spark):
    d = dt.date
    rows = [(d(2015, 1, 1), d(2016, 1, 1), 36, 1), (d(2015, 1, 1), d(2020, 1, 1), 36, 0),
            (d(2015, 1, 1), None, 36, 0), (d(2015, 1, 1), d(2016, 1, 1), 36, None), (d(2015, 1, 1), None, None, 0)]
    df = spark.createDataFrame(rows, "issue_d date, last_pymnt_date date, term_months int, is_default int")
    got = [r["duration_months"] for r in V.derive_survival(df).collect()]
    assert got[0] == pytest.approx(12, abs=0.5) and got[1:] == [36.0, 36.0, 36.0]
    sixty = spark.createDataFrame([(60, 0)], "term_months int, is_default int")
    assert V.derive_survival(sixty).first()["duration_months"] == 60.0


@pytest.mark.parametrize("censoring", [False, True])
def test_kaplan_meier(spark, censoring):
    rng = np.random.default_rng(0)
    t, e = rng.integers(1, 60, 800).astype(float), rng.integers(0, 2, 800)
    want = numpy_km(t, e == (0 if censoring else 1))
    got = {r["t"]: r["surv"] for r in V.kaplan_meier(frame(spark, t, e), of_censoring=censoring).collect()}
    assert got.keys() == want.keys()
    for u in want:
        assert got[u] == pytest.approx(want[u], abs=1e-12)


def test_kaplan_meier_groups(spark):
    rng = np.random.default_rng(1)
    t, e, g = rng.integers(1, 20, 400).astype(float), rng.integers(0, 2, 400), rng.integers(0, 3, 400)
    got = {(r["g"], r["t"]): r["surv"] for r in V.kaplan_meier(frame(spark, t, e, g=g), by=["g"]).collect()}
    for k in range(3):
        for u, s in numpy_km(t[g == k], e[g == k] == 1).items():
            assert got[float(k), u] == pytest.approx(s, abs=1e-12)


@pytest.mark.parametrize("seed,scores,hot", [(0, 25, False), (1, 400, True), (2, 1, False)])
def test_concordance_brute_force(spark, seed, scores, hot):
    rng = np.random.default_rng(seed)
    n = 500
    t = rng.integers(1, 50, n).astype(float)
    if hot:
        t[: n // 3] = 36.0
    e, s = rng.integers(0, 2, n), rng.integers(0, scores, n).astype(float)
    con = tie = comp = 0
    for i in range(n):
        if e[i]:
            later = (t > t[i]) | ((t == t[i]) & (e == 0))
            comp, con, tie = comp + later.sum(), con + (s[later] > s[i]).sum(), tie + (s[later] == s[i]).sum()
    r = V.concordance(frame(spark, t, e, score=s)).first()
    assert (r["concordant"], r["tied"], r["comparable"]) == (con, tie, comp)
    assert r["c_index"] == pytest.approx((con + tie / 2) / comp)


def test_concordance_small(spark):
    t, e = [5, 10, 15, 20], [1, 1, 1, 1]
    assert V.concordance(frame(spark, t, e, score=[1, 2, 3, 4])).first()["c_index"] == 1.0
    assert V.concordance(frame(spark, t, e, score=[4, 3, 2, 1])).first()["c_index"] == 0.0
    assert V.concordance(frame(spark, t, [0, 0, 0, 0], score=t)).first()["c_index"] is None


def numpy_brier(t, e, s, h):
    g = numpy_km(t, e == 0)
    times = np.array(sorted(g))

    def step(x):
        i = np.searchsorted(times, x, side="right") - 1
        return g[times[i]] if i >= 0 else 1.0

    total = 0.0
    for ti, ei, si in zip(t, e, s):
        if ti <= h and ei == 1:
            total += si ** 2 / max(step(ti - 1e-9), 1e-6)
        elif ti > h:
            total += (1 - si) ** 2 / max(step(h), 1e-6)
    return total / len(t)


def test_brier_brute_force(spark):
    rng = np.random.default_rng(3)
    t, e, s = rng.integers(1, 30, 600).astype(float), rng.integers(0, 2, 600), rng.random(600)
    df = frame(spark, t, e, s=s, s2=s * 0.8)
    got = {r["t"]: r["brier"] for r in V.brier_scores(df, {5.0: "s", 12.5: "s2", 29.0: "s"}).collect()}
    for h, sv in ((5.0, s), (12.5, s * 0.8), (29.0, s)):
        assert got[h] == pytest.approx(numpy_brier(t, e, sv, h), abs=1e-12)
    ibs = V.integrated_brier(df, {5.0: "s", 12.5: "s2", 29.0: "s"}).first()["ibs"]
    assert ibs == pytest.approx(np.trapezoid([got[5.0], got[12.5], got[29.0]], [5, 12.5, 29]) / 24)
    with pytest.raises(ValueError):
        V.integrated_brier(df, {5.0: "s"})


def test_brier_four(spark):
    t, e = [5, 30, 6, 32], [1, 0, 1, 0]
    assert V.brier_at(frame(spark, t, e, s=[.01, .99, .01, .99]), 12, "s").first()["brier"] < 0.05
    assert V.brier_at(frame(spark, t, e, s=[.99, .01, .99, .01]), 12, "s").first()["brier"] > 0.5


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(7)
    n = 500
    rate, dti = rng.uniform(5, 30, n), rng.uniform(5, 45, n)
    time = rng.exponential(1 / (0.02 * np.exp(0.08 * (rate - 15) + 0.03 * (dti - 25))))
    e = (time < 36).astype(int)
    t = np.maximum(np.ceil(np.minimum(time, 36.0)), 1.0)
    return rate, dti, t, e, frame(spark, t, e, int_rate=rate, dti=dti).cache()


@pytest.fixture(scope="module")
def cox(loans):
    return V.fit_cox(loans[4], ["int_rate", "dti"], penalizer=0.0)


def test_cox_is_the_efron_maximum(loans, cox):
    rate, dti, t, e, _ = loans
    x = np.c_[rate, dti] - np.array(cox.means)

    def loglik(b):
        w, out = np.exp(x @ b), 0.0
        for u in np.unique(t[e == 1]):
            dead = (t == u) & (e == 1)
            d = dead.sum()
            out += (x[dead] @ b).sum() - sum(np.log(w[t >= u].sum() - k / d * w[dead].sum()) for k in range(d))
        return out

    b = np.array(cox.beta)
    assert cox.log_likelihood == pytest.approx(loglik(b), rel=1e-9)
    for j in range(2):
        step = np.zeros(2)
        step[j] = 1e-3
        assert loglik(b) >= loglik(b + step) and loglik(b) >= loglik(b - step)


def test_large_ties_use_the_closed_form():
    m, d = np.array([500.3, 300.0, 80.0]), np.array([400.0, 300.0, 66.0])
    logs, inv, lin = V._falling_sums(m, d)
    for i in range(3):
        terms = m[i] - np.arange(int(d[i]))
        assert logs[i] == pytest.approx(np.log(terms).sum(), rel=1e-9)
        assert inv[i] == pytest.approx((1 / terms).sum(), rel=1e-8)
        assert lin[i] == pytest.approx((np.arange(int(d[i])) / terms).sum(), rel=1e-7)
        assert V._falling_squares(m, d)[i] == pytest.approx((1 / terms ** 2).sum(), rel=1e-7)


def test_cox_curves_and_ranking(spark, loans, cox):
    df = loans[4]
    two = spark.createDataFrame([(0, 8.0, 10.0), (1, 28.0, 40.0)], "id int, int_rate double, dti double")
    curves = V.predict_survival(two, cox, "id").toPandas().sort_values(["id", "t"])
    for _, c in curves.groupby("id"):
        s = c["surv"].to_numpy()
        assert ((s >= 0) & (s <= 1)).all() and (np.diff(s) <= 1e-12).all()
    med = [r["median"] for r in V.median_survival(two, cox, keep=["id"]).orderBy("id").collect()]
    assert med[1] <= med[0]
    below = curves[(curves["id"] == 1) & (curves["surv"] <= 0.5)]["t"]
    assert med[1] == (below.min() if len(below) else math.inf)
    at = V.survival_at(two, cox, [12], keep=["id"]).orderBy("id").collect()
    assert at[1]["surv_12"] == pytest.approx(curves[(curves["id"] == 1) & (curves["t"] <= 12)]["surv"].iloc[-1])
    scored = V.median_survival(df, cox, keep=["duration_months", "event"], out="score")
    assert V.concordance(scored).first()["c_index"] > 0.6


def test_median_lookup_paths_agree(spark, cox, monkeypatch):
    people = spark.createDataFrame([(i, 5.0 + i, 5.0 + 1.5 * i) for i in range(25)], "id int, int_rate double, dti double")
    small = {r["id"]: r["median"] for r in V.median_survival(people, cox, keep=["id"]).collect()}
    monkeypatch.setattr(V, "SMALL_CURVE_ROWS", 0)
    large = {r["id"]: r["median"] for r in V.median_survival(people, cox, keep=["id"]).collect()}
    assert small == large
