import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ordered as O


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    # a third of the rows share one key
    keys = np.where(rng.random(6000) < 0.33, 0.5, np.round(rng.random(6000), 3))
    pdf = [(int(g), float(k), int(v)) for g, k, v in zip(rng.integers(0, 3, 6000), keys, rng.integers(0, 9, 6000))]
    return spark.createDataFrame(pdf, "g int, k double, v bigint"), pdf


@pytest.mark.parametrize("by,shared", [([], True), (["g"], True), (["g"], False)])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(numbers, by, shared, descending):
    df, _ = numbers
    pre = df.groupBy(*by, "k").agg(F.sum("v").alias("v"))
    got = O.running_sums(pre, "k", {"v": "c"}, by=by, descending=descending, shared_bounds=shared,
                         small_groups=shared, totals={"v": "t"}).toPandas()
    got = got.sort_values([*by, "k"], ascending=[True] * len(by) + [not descending])
    want = got.groupby(by)["v"].cumsum() if by else got["v"].cumsum()
    assert (got["c"] == want).all()
    total = got.groupby(by)["v"].transform("sum") if by else got["v"].sum()
    assert (got["t"] == total).all()


def test_range_work_is_spread(numbers):
    df, _ = numbers
    pre = df.groupBy("k").agg(F.sum("v").alias("v"))
    sizes = [r["count"] for r in O.assign_ranges(pre, "k").groupBy("__range").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_exact_quantiles(numbers):
    df, rows = numbers
    probs = [0.0, 0.05, 0.37, 0.5, 0.99, 1.0]
    pre = df.groupBy("g", "k").agg(F.count("*").alias("n"))
    got = {r["g"]: r["quantiles"] for r in O.exact_quantiles(pre, "k", "n", probs, by=["g"]).collect()}
    for g in range(3):
        np.testing.assert_allclose(got[g], np.quantile([k for gg, k, _ in rows if gg == g], probs), rtol=1e-12)


def test_step_lookup(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(1000, 200, replace=False)) / 10.0
    v = rng.random(200)
    at = np.concatenate([rng.random(500) * 110, t[:20], [-1.0]])
    curve = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, v)], "t double, v double")
    points = spark.createDataFrame([(i, float(a)) for i, a in enumerate(at)], "i int, at double")
    got = {r["i"]: r["v"] for r in O.step_lookup(points, "at", curve, "t", "v").collect()}
    for i, a in enumerate(at):
        j = np.searchsorted(t, a, side="right") - 1
        assert got[i] == (v[j] if j >= 0 else 1.0)


def test_text_ranks(spark):
    words = ["b", "a", "MISSING", "ä", "a", "zz", "Z"]
    df = spark.createDataFrame([("x", w) for w in words] + [("y", "q")], "f string, w string")
    got = {(r["f"], r["w"]): r["rank"] for r in O.text_ranks(df, "f", "w").collect()}
    order = sorted(set(words), key=lambda w: w.encode())
    assert got == {**{("x", w): i for i, w in enumerate(order)}, ("y", "q"): 0}


def test_trapezoid(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (3.0, 0.0)], "x double, y double")
    assert O.trapezoid(df, "x", "y").first()["area"] == pytest.approx(5.5)
