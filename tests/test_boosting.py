"""Histogram boosting against a plain numpy version, and its edges."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting as H
from riskframe.operators import explain as E


def rows_of(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    logit = np.where(x[:, 0] > 0.3, 2.0, -1.0) + np.where(x[:, 1] * x[:, 0] > 0, 1.5, -0.5)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    # missing values carry a signal of their own
    gone = (rng.random(n) < np.where(y > 0, 0.3, 0.05))
    x[gone, 2] = np.nan
    return x, y


def frame(spark, x, y, parts=4):
    data = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, label double").repartition(parts, "id")


def plain_fit(x, y, cuts, n_trees, depth, rate, l2, min_hessian):
    """Margins by recursion over row sets and every cut."""
    mean = y.mean()
    margin = np.full(len(y), np.log(mean / (1 - mean)))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * H.UNIT) / H.UNIT, np.rint(p * (1 - p) * H.UNIT) / H.UNIT
        step = np.zeros(len(y))

        def grow(rows, level):
            G, S = g[rows].sum(), h[rows].sum()
            step[rows] = -rate * G / (S + l2)
            best = (1e-12, None)
            for f in range(x.shape[1]) if level < depth else ():
                v = x[rows, f]
                for missing_left in (True, False):
                    for cut in [*cuts[f], np.inf]:
                        left = np.where(np.isnan(v), missing_left, v <= cut)
                        if left.all() or not left.any():
                            continue
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if min(hl, S - hl) < min_hessian:
                            continue
                        gain = 0.5 * (gl ** 2 / (hl + l2) + (G - gl) ** 2 / (S - hl + l2) - G ** 2 / (S + l2))
                        if gain > best[0] + 1e-12 * abs(best[0]):
                            best = (gain, left)
            if best[1] is not None:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + step
    return margin


def test_margins_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(H, "REFRESH", 2)  # margins are carried on twice
    x, y = rows_of()
    df = frame(spark, x, y)
    cuts = [[-1.0, -0.2, 0.3, 1.1], [-0.5, 0.0, 0.5], [0.0]]
    model = H.fit_hist_boost(df, ["a", "b", "c"], n_trees=5, depth=3, rate=0.3, cuts=cuts)
    got = {r.id: (r.score, r.margin) for r in H.score_hist_boost(df, model, ["id"], margin="margin").collect()}
    want = plain_fit(x, y, cuts, 5, 3, 0.3, H.L2, H.MIN_HESSIAN)
    assert max(abs(got[i][1] - want[i]) for i in range(len(y))) < 1e-6
    assert max(abs(got[i][0] - 1 / (1 + np.exp(-want[i]))) for i in range(len(y))) < 1e-6
    # the side of missing values is learned somewhere
    assert any((t.feature == 2).any() for t in model.trees)


def test_same_model_however_rows_are_dealt_out(spark):
    x, y = rows_of(1500)
    models = [H.fit_hist_boost(frame(spark, x, y, n), ["a", "b", "c"], n_trees=2, depth=3, cuts=[[0.0, 0.5], [0.0], [0.1]]).to_json()
              for n in (1, 7)]
    assert models[0] == models[1]
    assert H.HistModel.from_json(models[0]).to_json() == models[0]


def test_learns_more_than_a_constant(spark):
    x, y = rows_of()
    df = frame(spark, x, y)
    model = H.fit_hist_boost(df, ["a", "b", "c"], n_trees=10, depth=3, rate=0.3)
    scored = H.score_hist_boost(df, model, ["label"]).toPandas()
    order = scored["score"].rank()
    pos = scored["label"] == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85


def test_attributions_add_up_with_missing_values(spark):
    x, y = rows_of(800)
    df = frame(spark, x, y)
    model = H.fit_hist_boost(df, ["a", "b", "c"], n_trees=3, depth=3, rate=0.3)
    margins = {r.id: r.margin for r in H.score_hist_boost(df, model, ["id"], margin="margin").collect()}
    for r in E.tree_maps(df, model, ["a", "b", "c"], "id").collect():
        assert r.base_value + sum(r.attributions.values()) == pytest.approx(margins[r.id], abs=1e-9)


def test_edges(spark):
    schema = "id long, a double, label double"
    empty = H.fit_hist_boost(spark.createDataFrame([], schema), ["a"])
    assert empty.trees == [] and empty.base_margin == 0.0
    one = H.fit_hist_boost(spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 2.0, None)], schema), ["a"], n_trees=3)
    assert one.base_margin > 10
    assert H.score_hist_boost(spark.createDataFrame([(1, None, 1.0)], schema), one, ["id"]).first().score > 0.99
    nulls = spark.createDataFrame([(i, None, float(i % 2)) for i in range(10)], schema)
    flat = H.fit_hist_boost(nulls, ["a"], n_trees=2)
    assert all((t.feature < 0).all() for t in flat.trees)
    with pytest.raises(ValueError):
        H.fit_cuts(nulls, ["a"], 400)
    # cuts are at most a sketch's rank error away, and given ones are kept
    ten = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    assert H.fit_cuts(ten, ["a"], 4) == [[249.0, 499.0, 749.0]]


def test_model_type_of_the_training_run(spark):
    from riskframe.operators import models as ML

    x, y = rows_of(600)
    df = frame(spark, x, y).withColumn("kind", F.when(F.col("a") > 0, "u").otherwise("v"))
    model = ML.train_credit_model(df, "hist_gbt", {"n_trees": 2, "depth": 2}, ["a", "b", "c"], ["kind"], target="label")
    got = model.score(df, ["label"])
    assert got.columns == ["label", "score"] and got.count() == 600


def test_a_tree_level_is_one_job_without_a_shuffle(spark):
    x, y = rows_of(3000)
    cuts = [[-0.5, 0.0, 0.5], [0.0], [0.1]]
    df = frame(spark, x, y).select("a", "b", "c", "label")
    state, sizes = H._state(df, ["a", "b", "c"], "label", cuts, 0.0), [5, 3, 3]
    tree = H.HistTree.empty(2)
    tree.feature[0], tree.cut[0], tree.missing_left[0] = 2, 0, True
    sc = spark.sparkContext
    top = H.level_sums(state, [], tree, 0, sizes)
    tree.rows[0] = top[0, :5, 2].sum()
    tree.rows[2] = top[0, 8 + 1, 2]
    tree.rows[1] = tree.rows[0] - tree.rows[2]
    sc.setJobGroup("one-level", "one-level")
    try:
        less = H.level_sums(state, [], tree, 1, sizes, top)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("one-level")
    assert len(jobs) == 1 and len(sc.statusTracker().getJobInfo(jobs[0]).stageIds) == 1
    # the child that is not summed has what its parent's sums leave, exactly
    assert (less == H.level_sums(state, [], tree, 1, sizes)).all() and less[:, :5, 2].sum() == len(y)


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_leaf_masks_are_the_walked_trees(depth):
    rng = np.random.default_rng(depth)
    trees = []
    for _ in range(3):
        t = H.HistTree.empty(depth)
        inner = (1 << depth) - 1
        t.feature[:inner], t.cut[:inner] = rng.integers(0, 3, inner), rng.integers(0, 9, inner)
        t.missing_left[:inner] = rng.random(inner) < 0.5
        t.feature[rng.integers(1, inner, 2)] = -1
        t.value[:] = rng.normal(size=len(t.value))
        trees.append(t)
    bins = rng.integers(0, 10, (500, 3)).astype(np.uint8)
    rows = np.where(bins == 9, H.MISSING, bins).astype(np.uint8)
    want = sum(t.values(rows) for t in trees)
    assert (H.tree_total(trees, np.ascontiguousarray(bins.T), [9] * 3) == want).all()


def test_grouped_leaves_have_the_shapley_values_of_each_leaf():
    rng = np.random.default_rng(5)
    games = [(rng.normal(), [], [], [])]
    for _ in range(60):
        fs = sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist())
        ends = [(-np.inf, -0.5, 0.0, 0.5, np.inf)[k:k + 2] for k in rng.integers(0, 4, len(fs))]
        ends = [(np.inf, np.inf) if rng.random() < 0.1 else e for e in ends]  # admits missing values only
        games.append((rng.normal(), fs, [(*e, bool(rng.integers(2))) for e in ends], rng.random(len(fs)).tolist()))
    x = rng.normal(size=(40, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    want = np.zeros((len(x), 6))
    for value, fs, boxes, shares in games:
        inside = np.array([[b[2] if np.isnan(r[f]) else b[0] < r[f] <= b[1] for f, b in zip(fs, boxes)] for r in x], float)
        for j, f in enumerate(fs):
            others = [k for k in range(len(fs)) if k != j]
            for size in range(len(fs)):
                for s in combinations(others, size):
                    weight = factorial(size) * factorial(len(fs) - size - 1) / factorial(len(fs))
                    part = np.prod([inside[:, k] if k in s else np.full(len(x), shares[k]) for k in others], axis=0)
                    want[:, f] += weight * value * part * (inside[:, j] - shares[j])
    assert E.shapley_games(games, 6)(x) == pytest.approx(want, abs=1e-9)
    whole = np.nan_to_num(x)
    assert E.shapley_games(games, 6)(np.concatenate([whole, x]))[len(x):] == pytest.approx(want, abs=1e-9)
