import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators import explain as E
from riskframe.operators import models as ML
from riskframe.operators import prep as T

FEATURES = ["dti_eff", "int_rate", "annual_inc", "loan_amnt"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 400
    dti, rate = rng.uniform(5, 45, n), rng.uniform(5, 30, n)
    inc, amt = rng.uniform(20e3, 150e3, n), rng.uniform(1e3, 40e3, n)
    y = (0.08 * (dti - 25) + 0.2 * (rate - 17) + rng.normal(size=n) > 0).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(dti, rate, inc, amt, y))]
    return spark.createDataFrame(rows, "id int, dti_eff double, int_rate double, annual_inc double, loan_amnt double, "
                                       "label double").cache()


@pytest.fixture(scope="module")
def assembled(data):
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data).cache()


@pytest.fixture(scope="module")
def logreg(assembled):
    return ML.fit_logreg(assembled)


@pytest.fixture(scope="module")
def gbt(assembled):
    return ML.fit_gbt(assembled, params={"maxIter": 4, "maxDepth": 3})


def test_scores_and_decisions(assembled, logreg):
    scored = ML.score(assembled, logreg, keep=["id", "label"])
    s = scored.toPandas()
    assert s["score"].between(0, 1).all() and s[s.label == 1]["score"].mean() > s[s.label == 0]["score"].mean()
    d = ML.decide(scored, "score", "id").toPandas()
    assert set(d["risk_tier"]) <= {"low", "medium", "high"} and (d["approved"] == (d["risk_score"] < 0.2)).all()
    made = ML.decide(scored.limit(2), "score").collect()
    assert all(r["score_id"].startswith("score-") for r in made)
    with pytest.raises(ValueError):
        ML.score(assembled, None)
    with pytest.raises(ValueError):
        ML.fit_model(assembled, "forest")


def test_save_and_load(assembled, logreg, tmp_path):
    ML.save_model(logreg, str(tmp_path / "m"))
    again = ML.load_model(str(tmp_path / "m"))
    a = ML.score(assembled, logreg, keep=["id"]).toPandas()
    b = ML.score(assembled, again, keep=["id"]).toPandas()
    np.testing.assert_allclose(a["score"], b["score"])
    with pytest.raises(FileNotFoundError):
        ML.load_model(str(tmp_path / "none"))


def test_linear_attributions_add_up(data, assembled, logreg):
    attr = E.attribute_linear(data, logreg, data, FEATURES, "id")
    got = attr.groupBy("id").agg((F.sum("attribution") + F.first("base_value")).alias("m"))
    margin = assembled.select("id", "features").toPandas()
    want = {int(i): float(logreg.coefficients.dot(v) + logreg.intercept) for i, v in margin.itertuples(index=False)}
    for r in got.collect():
        assert r["m"] == pytest.approx(want[r["id"]], abs=1e-9)
    with pytest.raises(ValueError):
        E.attribute_linear(data, logreg, None, FEATURES, "id")
    top = E.top_attributions(attr, 2)
    assert top.groupBy("id").count().where("count != 2").count() == 0
    assert {r["feature"] for r in E.global_importance(attr).limit(2).collect()} == {"dti_eff", "int_rate"}
    rec = E.attribution_records(attr, "m").first()
    assert set(rec["attributions"]) == set(FEATURES)
    with pytest.raises(ValueError):
        E.check_same_rows(data.limit(3), attr)


def subset_values(leaves, x, known):
    """Expected margin with only ``known`` features given."""
    total = 0.0
    for value, feats, boxes, shares in leaves:
        w = value
        for f, (lo, hi), r in zip(feats, boxes, shares):
            w *= float(lo < x[f] <= hi) if f in known else r
        total += w
    return total


def test_tree_attributions_are_shapley_values(spark, data, gbt):
    from itertools import combinations
    from math import factorial
    leaves = E.tree_leaves(gbt, spark)
    rows = data.orderBy("id").limit(5)
    attr = E.attribute_trees(rows, gbt, FEATURES, "id").collect()
    got = {(r["id"], r["feature"]): r["attribution"] for r in attr}
    p = len(FEATURES)
    for row in rows.collect():
        x = [row[f] for f in FEATURES]
        for j in range(p):
            phi = 0.0
            for k in range(p):
                for c in combinations([i for i in range(p) if i != j], k):
                    weight = factorial(k) * factorial(p - k - 1) / factorial(p)
                    phi += weight * (subset_values(leaves, x, {*c, j}) - subset_values(leaves, x, set(c)))
            assert got[row["id"], FEATURES[j]] == pytest.approx(phi, abs=1e-9)


def test_tree_attributions_add_up(data, assembled, gbt):
    attr = E.attribute_trees(data, gbt, FEATURES, "id")
    got = {r["id"]: r["m"] for r in attr.groupBy("id").agg((F.sum("attribution") + F.first("base_value")).alias("m")).collect()}
    for r in gbt.transform(assembled).select("id", "rawPrediction").collect():
        # the raw prediction is the margin on both sides of zero
        assert got[r["id"]] == pytest.approx(r["rawPrediction"][1], abs=1e-9)


def test_counterfactuals(data, assembled, logreg):
    declined = data.where("id < 40 and label = 1").limit(10)
    vary = ["int_rate", "dti_eff"]
    cf = E.counterfactuals(declined, logreg, data, FEATURES, "id", vary=vary, k=3, tries=100).cache()
    assert cf.count() > 0 and cf.where("score >= 0.5").count() == 0 and cf.where("rank > 3").count() == 0
    moved = cf.join(declined.select("id", F.col("annual_inc").alias("a0"), F.col("loan_amnt").alias("l0")), "id")
    assert moved.where("annual_inc != a0 or loan_amnt != l0").count() == 0
    report = E.change_report(declined, cf, FEATURES, "id").collect()
    assert report and {r["parameter"] for r in report} <= set(vary)
    with pytest.raises(ValueError):
        E.counterfactuals(declined, logreg, data, FEATURES, "id", vary=["nope"])
    # a class nobody can reach: every asking row still comes out, flagged
    none = E.counterfactuals(declined, logreg, data, FEATURES, "id", vary=vary, tries=5, threshold=0.0)
    assert none.where("found or rank is not null").count() == 0
    assert none.select("id").distinct().count() == none.count() == declined.select("id").distinct().count()


@pytest.fixture(scope="module")
def mart_5rows(spark):
    days = ["2016-03-01", "2017-06-15", "2017-11-20", "2018-02-10", "2018-05-01"]
    rows = []
    for i, day in enumerate(days):
        nums = {c: float(i + 1) for c in S.NUMERICAL_FEATURES}
        cats = {c: "ABABA"[i] for c in S.CATEGORICAL_FEATURES}
        rows.append({"id": i, "issue_d": day, **nums, **cats, "is_default": float(i % 2)})
    rows[2]["loan_amnt"] = rows[3]["int_rate"] = rows[4]["is_default"] = None
    rows[1]["grade"] = None
    ddl = ("id int, issue_d string, " + ", ".join(f"{c} double" for c in S.NUMERICAL_FEATURES) + ", "
           + ", ".join(f"{c} string" for c in S.CATEGORICAL_FEATURES) + ", is_default double")
    order = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], ddl)


def test_preparation(mart_5rows):
    ready = T.preprocess(mart_5rows).toPandas().sort_values("id")
    assert not ready[S.NUMERICAL_FEATURES].isna().any().any()
    # medians of 1, 2, 4, 5 and of 1, 2, 3, 5
    assert ready["loan_amnt"][2] == 3.0 and ready["int_rate"][3] == 2.5
    # A, B, MISSING
    assert list(ready["grade"]) == [0, 2, 0, 1, 0]
    train, test = T.temporal_split(mart_5rows)
    assert (train.count(), test.count()) == (3, 1)
    x = T.prepare(T.preprocess(mart_5rows), keep=["id"])
    assert len(x.first()["features"]) == 30
    with pytest.raises(ValueError, match="nope"):
        T.align_features(mart_5rows, ["id", "nope"])


def test_all_null_median_and_unseen_category(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, g string")
    assert T.fit_imputer(df, ["x"]).values == {"x": 0.0}
    codes = T.fit_codes(df, ["g"])
    other = spark.createDataFrame([("b",), ("zzz",)], "g string")
    assert sorted(r["g"] for r in codes.apply(other).collect()) == [-1, 1]
