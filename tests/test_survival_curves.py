"""Curves of every individual at any baseline size, and fits that tell how they ended."""

import numpy as np
import pytest

from riskframe.operators import survival as V
from riskframe.plans.catalog import CURVE_TIMES, QUERIES


def test_curves_beyond_one_array(spark, monkeypatch):
    baseline = spark.createDataFrame([(float(t), 0.01 * t) for t in range(1, 40)], "t double, h0 double")
    model = V.CoxModel(("x",), (0.5,), (1.0,), 0.0, baseline, 39)
    people = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, x double")
    curves = lambda: sorted((r.id, r.t, round(r.surv, 12)) for r in V.predict_survival(people, model, "id").collect())
    small = curves()
    monkeypatch.setattr(V, "SMALL_CURVE_ROWS", 0)
    assert len(small) == 5 * 39 and curves() == small


def test_a_fit_tells_whether_it_converged(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(1, 30)), int(rng.integers(0, 2)), float(x)) for x in rng.normal(size=200)]
    df = spark.createDataFrame(rows, f"{V.DURATION} double, {V.EVENT} int, x double")
    done, cut = V.fit_cox(df, ["x"]), V.fit_cox(df, ["x"], max_iter=0)
    assert done.converged and done.iterations > 0
    assert not cut.converged and cut.iterations == 0


def test_each_line_item_has_its_curve(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(orders, V.F.col("l_orderkey") == V.F.col("o_orderkey"))
    got = QUERIES["line_survival_curves"](spark, sf_dir)
    assert got.count() == lines.count() * len(CURVE_TIMES)
    keys = lines.select("l_orderkey", "l_linenumber").distinct().count()  # the test table repeats some
    assert got.select("order_key", "line_number", "t").distinct().count() == keys * len(CURVE_TIMES)
