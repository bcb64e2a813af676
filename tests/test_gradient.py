import math
import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.operators import gradient as G
from riskframe.operators import models as ML

FEATURES = ["rate", "income", "grade", "flat", "copy"]


def frame(spark, n, parts=1):
    """Rows with repeated values, zeros, a constant, and a copy of a feature that ties with it in every split."""
    rng = np.random.default_rng(3)
    rate, income = np.round(rng.uniform(5, 30, n), 2), rng.normal(50, 20, n)
    grade = rng.integers(0, 4, n).astype(float)
    label = (0.2 * (rate - 17) - 0.03 * (income - 50) + 0.5 * grade + rng.normal(size=n) > 0.5).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(rate, income, grade, np.ones(n), -rate, label))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts),
                               "id int, rate double, income double, grade double, flat double, copy double, label double")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).cache()


def described(model, digits=17):
    trees = [re.sub(r"(Predict: )(\S+)", lambda m: f"{m[1]}{float(m[2]):.{digits}g}", t.toDebugString) for t in model.trees]
    return [re.sub("uid=[^,]+", "", t).split("\n", 1)[1] for t in trees]


def spark_fit(df, params):
    return GBTClassifier(featuresCol="features", labelCol="label", **{**ML.GBT_PARAMS, **params}).fit(df)


@pytest.mark.parametrize("n, parts, params", [
    (600, 1, {"maxIter": 12}), (11_000, 1, {"maxIter": 4, "maxDepth": 3}), (20, 1, {"maxIter": 3, "maxDepth": 2}),
    (3_000, 1, {"maxIter": 3, "maxDepth": 6, "maxBins": 9, "seed": 7})])
def test_trees_are_spark_mls(spark, n, parts, params):
    df = frame(spark, n, parts)
    got, want = ML.fit_gbt(df, params=params), spark_fit(df, params)
    assert described(got) == described(want)  # to the last bit, as there is one partition
    assert got.treeWeights == want.treeWeights and got.numFeatures == want.numFeatures
    assert got.featureImportances == want.featureImportances
    assert {p.name: v for p, v in got.extractParamMap().items()} == {p.name: v for p, v in want.extractParamMap().items()}


@pytest.mark.parametrize("parts, direct", [(5, 256), (20, 256), (5, 2)])  # 20 are more than there are cores
def test_many_partitions_give_the_same_scores(spark, monkeypatch, parts, direct):
    monkeypatch.setattr(G, "BLOCK", 256)
    monkeypatch.setattr(G, "DIRECT_PARTS", direct)
    df = frame(spark, 4_000, parts)
    params = {"maxIter": 12, "maxDepth": 4}
    got, want = ([r["score"] for r in ML.score(df, m, keep=["id"]).orderBy("id").collect()]
                 for m in (ML.fit_gbt(df, params=params), spark_fit(df, params)))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_fit_keeps_bytes_not_rows(spark, monkeypatch):
    """Spark's own fit keeps an object a row and walks it for every level."""
    def refuse(self, dataset, params=None):
        raise AssertionError("rows are kept as objects")

    df, sizes = frame(spark, 20_000, 2), []
    monkeypatch.setattr(GBTClassifier, "fit", refuse)

    def sums(blocks, *rest, level_sums=G._level_sums):
        out = level_sums(blocks, *rest)
        sizes.extend(sum(map(len, block)) / len(block[0]) for block in blocks.collect())
        return out

    monkeypatch.setattr(G, "_level_sums", sums)
    ML.fit_gbt(df, params={"maxIter": 2, "maxDepth": 2})
    assert set(sizes) == {9 + len(FEATURES)}
    assert not [i for i in spark.sparkContext._jsc.sc().getRDDStorageInfo() if "PythonRDD" in i.name()]


def test_exp_has_the_jvms_bits(spark):
    x = np.random.default_rng(0).uniform(-40, 40, 500)
    jvm = spark.sparkContext._jvm.java.lang.Math
    assert G.java_exp(x).tolist() == [jvm.exp(float(v)) for v in x]
    np.testing.assert_allclose(G.java_exp(np.array([0.0, 705.0, -1e-20])), [1.0, math.exp(705.0), 1.0], rtol=1e-15)


def test_other_settings_and_bad_rows_are_left_to_spark(spark):
    df = frame(spark, 300)
    params = {"maxIter": 2, "maxDepth": 2, "subsamplingRate": 0.5}
    assert described(ML.fit_gbt(df, params=params)) == described(spark_fit(df, params))
    for wrong in (df.where("id < 0"), df.withColumn("label", F.col("label") + 1),
                  df.withColumn("label", F.when(F.col("id") > 0, F.col("label")))):
        with pytest.raises(Exception) as ours:
            ML.fit_gbt(wrong, params={"maxIter": 2})
        with pytest.raises(type(ours.value)):
            spark_fit(wrong, {"maxIter": 2})


def test_saved_models_load(spark, tmp_path):
    df = frame(spark, 300)
    model = ML.fit_gbt(df, params={"maxIter": 3, "maxDepth": 3})
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(str(tmp_path / "m"))
    a, b = (ML.score(df, m, keep=["id"]).orderBy("id").collect() for m in (model, again))
    assert a == b
