"""Attributions of a score to features, and counterfactual changes, as batch jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.scalar import differs, direction, format_value
from riskframe.operators.boosting import HistModel
from riskframe.session import ensure_checkpoint_dir

FEATURE, VALUE, ATTRIBUTIONS = "feature", "attribution", "attributions"
# tests whose outcomes are tabled together: 2^10 values a feature
GROUP_TESTS = 10


# ---- attributions -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Scorecard:
    """A linear score with given weights, usable wherever a fitted linear model is."""

    intercept: float
    coefficients: DenseVector


def linear_base(model: Any, background: DataFrame, features: Sequence[str]) -> tuple[float, list[float]]:
    """Base value on the margin scale, and the background mean per feature."""
    row = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(features))]
    base = float(model.intercept) + sum(float(b) * m for b, m in zip(model.coefficients.toArray(), means))
    return base, means


def long_form(maps: DataFrame) -> DataFrame:
    """(id, feature, attribution, base_value) of one-map-a-row attributions."""
    return maps.select("id", F.explode(ATTRIBUTIONS).alias(FEATURE, VALUE), "base_value")


def linear_maps(df: DataFrame, model: Any, background: DataFrame | None, features: Sequence[str],
                id_col: str) -> DataFrame:
    """(id, attributions, base_value), a feature -> attribution map a row: coefficient times distance from the mean."""
    if background is None:
        raise ValueError("a linear model needs background rows")
    base, means = linear_base(model, background, features)
    parts = [F.lit(float(b)) * (F.col(f).cast("double") - F.lit(float(m)))
             for f, b, m in zip(features, model.coefficients.toArray(), means)]
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*parts))
    return df.select(F.col(id_col).alias("id"), named.alias(ATTRIBUTIONS), F.lit(base).alias("base_value"))


def attribute_linear(df: DataFrame, model: Any, background: DataFrame | None, features: Sequence[str],
                     id_col: str) -> DataFrame:
    """``linear_maps`` in long form."""
    return long_form(linear_maps(df, model, background, features, id_col))


def tree_leaves(model: Any, spark: SparkSession) -> list[tuple]:
    """Leaves of a boosted ensemble: (weighted value, features, intervals, shares).

    Read from the node table that the model writer saves; its size is set by trees and depth, not
    by data.  Per leaf and split feature: the admitted interval (lo, hi] and the share of training
    rows that follow the path.
    """
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    split = F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.rawCount").alias("n"), split["featureIndex"].alias("f"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"))
    nodes = {(r["treeID"], r["id"]): r for r in rows.collect()}
    leaves = []
    for tree, weight in enumerate(model.treeWeights):
        stack = [(nodes[tree, 0], {}, {})]
        while stack:
            node, box, share = stack.pop()
            if node["leftChild"] < 0:
                feats = sorted(box)
                leaves.append((weight * node["prediction"], feats, [box[f] for f in feats], [share[f] for f in feats]))
                continue
            left, right = nodes[tree, node["leftChild"]], nodes[tree, node["rightChild"]]
            f, cut = node["f"], node["cut"]
            lo, hi = box.get(f, (-np.inf, np.inf))
            total = left["n"] + right["n"]
            for child, side in ((left, (lo, min(hi, cut))), (right, (max(lo, cut), hi))):
                part = share.get(f, 1.0) * (child["n"] / total if total else 0.5)
                stack.append((child, {**box, f: side}, {**share, f: part}))
    return leaves


def _coalition_weights(m: int) -> np.ndarray:
    """Shapley weights |S|! (m - |S| - 1)! / m! for |S| = 0..m-1."""
    fact = np.cumprod([1.0, *range(1, m + 1)])
    return fact[:m] * fact[:m][::-1] / fact[m]


def _game_table(value: float, shares: Sequence[float]) -> np.ndarray:
    """(2^m x m): the Shapley values of a leaf's game, by which of its m features admit the row."""
    m = len(shares)
    inside = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    w, out = _coalition_weights(m), np.zeros((1 << m, m))
    for j in range(m):
        # poly[s]: sum over coalitions of size s of the other features
        poly = np.zeros((m, 1 << m))
        poly[0] = 1.0
        for k in range(m):
            if k == j:
                continue
            grown = poly * shares[k]
            grown[1:] += poly[:-1] * inside[:, k]
            poly = grown
        out[:, j] = value * (w @ poly) * (inside[:, j] - shares[j])
    return out


def shapley_games(games: Sequence[tuple], p: int) -> Callable[[np.ndarray], np.ndarray]:
    """Function (rows x p values) -> (rows x p Shapley values), summed over leaves (value, features, boxes, shares).

    A leaf's values depend on the row only by which of its boxes admit the row.  Neighbouring leaves test few
    cuts between them, so their values together are worked out once for every outcome of up to ``GROUP_TESTS``
    tests: (feature, cut) for values at most the cut, (feature, None) for missing ones where a batch has any.
    """
    tables = [_game_table(value, shares) for value, _, _, shares in games]

    def tests_of(fs: Sequence[int], boxes: Sequence[tuple], gone: frozenset) -> list[tuple]:
        found = [(f, float(cut)) for f, box in zip(fs, boxes) for cut, free in zip(box, (-np.inf, np.inf)) if cut != free]
        return found + [(f, None) for f in fs if f in gone]

    def group(members: list[int], tests: dict[tuple, int], gone: frozenset) -> tuple:
        """(tests, {feature: values by outcome})"""
        outcome = np.arange(1 << len(tests))
        true = {t: (outcome >> k & 1).astype(bool) for t, k in tests.items()}
        sums: dict[int, np.ndarray] = {}
        for i in members:
            _, fs, boxes, _ = games[i]
            which = np.zeros(len(outcome), np.intp)
            for j, (f, box) in enumerate(zip(fs, boxes)):
                inside = np.ones(len(outcome), bool)
                if box[0] != -np.inf:
                    inside &= ~true[f, float(box[0])]
                if box[1] != np.inf:
                    inside &= true[f, float(box[1])]
                if f in gone:  # a box may say whether missing values are in it; otherwise none are
                    inside = np.where(true[f, None], box[2:] == (True,), inside)
                which += inside.astype(np.intp) << j
            for f, column in zip(fs, tables[i].T):
                sums[f] = sums.get(f, 0.0) + column.take(which)
        return list(tests), sums

    @cache
    def groups(gone: frozenset) -> list[tuple]:
        out, members, tests = [], [], {}
        for i, (_, fs, boxes, _) in enumerate(games):
            own = tests_of(fs, boxes, gone)
            if members and len({*tests, *own}) > GROUP_TESTS:
                out.append(group(members, tests, gone))
                members, tests = [], {}
            members.append(i)
            for t in own:
                tests.setdefault(t, len(tests))
        return [*out, group(members, tests, gone)] if members else out

    def shapley(x: np.ndarray) -> np.ndarray:
        nan = np.isnan(x)
        parts = groups(frozenset(np.flatnonzero(nan.any(0)).tolist()))
        passed = {t: (nan[:, t[0]] if t[1] is None else x[:, t[0]] <= t[1]).astype(np.uint32)
                  for t in {t for tests, _ in parts for t in tests}}
        phi = np.zeros((p, len(x)))
        for tests, sums in parts:
            which = np.zeros(len(x), np.uint32)
            for k, t in enumerate(tests):
                which |= passed[t] << np.uint32(k)
            at = which.astype(np.intp)
            for f, values in sums.items():
                phi[f] += values.take(at)
        return phi.T

    return shapley


def tree_maps(df: DataFrame, model: Any, features: Sequence[str], id_col: str) -> DataFrame:
    """(id, attributions, base_value) for boosted trees, on the margin scale.

    A leaf is a product game over the few features on its path: a feature in the coalition must
    admit the row, one outside counts with its share of training rows.  Shapley values of that game
    are exact and additive: base + sum of attributions = margin.
    """
    games = model.leaves() if isinstance(model, HistModel) else tree_leaves(model, df.sparkSession)
    base = float(sum(v * np.prod(r) for v, _, _, r in games))
    feats, p = list(features), len(features)
    shared = df.sparkSession.sparkContext.broadcast(games)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapley = shapley_games(shared.value, p)
        for pdf in batches:
            x = pdf[feats].to_numpy(float)
            phi = np.concatenate([np.zeros((0, p)), *(shapley(x[at:at + 4096]) for at in range(0, len(x), 4096))])
            yield pd.DataFrame({"id": pdf["id"], "phi": list(phi)})

    rows = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in feats])
    kind = dict(rows.dtypes)["id"]
    phi = rows.mapInPandas(run, f"id {kind}, phi array<double>")
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in feats]), F.col("phi"))
    return phi.select("id", named.alias(ATTRIBUTIONS), F.lit(base).alias("base_value"))


def attribute_trees(df: DataFrame, model: Any, features: Sequence[str], id_col: str) -> DataFrame:
    """``tree_maps`` in long form."""
    return long_form(tree_maps(df, model, features, id_col))


def _as_maps(attr: DataFrame) -> DataFrame:
    """Map form; the long form is grouped by id for it, which shuffles."""
    if ATTRIBUTIONS in attr.columns:
        return attr
    entries = F.map_from_entries(F.collect_list(F.struct(FEATURE, VALUE)))
    return attr.groupBy("id").agg(entries.alias(ATTRIBUTIONS), F.first("base_value").alias("base_value"))


def top_attributions(attr: DataFrame, n: int = 10) -> DataFrame:
    """The n largest attributions per id by absolute value, with the direction of the effect.

    Takes the map form, which needs no shuffle, or the long form.  NaN comes first, NULL last.
    """
    keyed = F.transform(F.map_entries(ATTRIBUTIONS), lambda e: F.struct(
        e["value"].isNull().alias("none"), (~F.isnan(e["value"])).alias("number"), (-F.abs(e["value"])).alias("size"),
        e["key"].alias(FEATURE), e["value"].alias(VALUE)))
    best = F.slice(F.array_sort(keyed), 1, n)
    return _as_maps(attr).select("id", "base_value", F.posexplode(best).alias("pos", "e")).select(
        "id", f"e.{FEATURE}", f"e.{VALUE}", "base_value", (F.col("pos") + 1).alias("rank")).withColumn(
        "direction", direction(VALUE))


def global_importance(attr: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute attribution, largest first."""
    return attr.groupBy(FEATURE).agg(F.avg(F.abs(VALUE)).alias("importance")).orderBy(F.desc("importance"), FEATURE)


def attribution_records(attr: DataFrame, model_name: str, created_at: datetime | None = None) -> DataFrame:
    """One row per id with a feature -> attribution map (at most one entry per model feature)."""
    stamp = created_at or datetime.now(UTC)
    return _as_maps(attr).select(
        F.col("id").alias("loan_id"), F.lit(model_name).alias("model_name"), ATTRIBUTIONS,
        F.lit(stamp).cast("timestamp").alias("created_at"))


def check_same_rows(ids: DataFrame, attr: DataFrame) -> None:
    """Refuse attributions that do not cover exactly the given ids."""
    a, b = ids.count(), attr.select("id").distinct().count()
    if a != b:
        raise ValueError(f"{a} ids but attributions for {b}")


# ---- counterfactuals --------------------------------------------------------------------------

def _uniform(id_col: str, *salt: Column) -> Column:
    """Number in [0, 1) fixed by id and salt, the same on every run and executor."""
    return F.pmod(F.xxhash64(F.col(id_col), *salt), F.lit(1 << 30)) / F.lit(float(1 << 30))


def counterfactuals(df: DataFrame, model: Any, train: DataFrame, features: Sequence[str], id_col: str,
                    vary: Sequence[str] | None = None, k: int = 3, desired_class: int = 0,
                    tries: int = 200, threshold: float = 0.5) -> DataFrame:
    """Random-search counterfactuals: up to ``k`` changed copies per row in the desired class.

    Each row gets ``tries`` candidates with one, two, ... varied features drawn from the training
    ranges; candidates are scored as ordinary rows, and the closest by range-scaled distance stay.
    Returns (id, rank, distance, score, found, features...).  A row for which no candidate reaches the
    class comes out once, with ``found`` false and NULL elsewhere.
    """
    vary = list(vary or features)
    unknown = [f for f in vary if f not in features]
    if unknown:
        raise ValueError(f"not model features: {unknown}")
    ranges = train.agg(*[F.min(F.col(f).cast("double")).alias(f"lo_{f}") for f in vary],
                       *[F.max(F.col(f).cast("double")).alias(f"hi_{f}") for f in vary]).first()
    base = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    cand = base.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    # the number of varied features grows with the try number; hash order picks which ones
    width = F.ceil(F.col("try") * F.lit(float(len(vary))) / F.lit(float(tries))).cast("int")
    order = {f: _uniform("id", F.col("try"), F.lit(f), F.lit("pick")) for f in vary}
    cand = cand.withColumns({f"__p_{f}": e for f, e in order.items()}).withColumn("__w", width)
    ahead = {f: sum((F.when(F.col(f"__p_{g}") < F.col(f"__p_{f}"), 1).otherwise(0) for g in vary if g != f),
                    F.lit(0)) for f in vary}
    drawn = {f: F.lit(ranges[f"lo_{f}"]) + _uniform("id", F.col("try"), F.lit(f), F.lit("value"))
             * F.lit(ranges[f"hi_{f}"] - ranges[f"lo_{f}"]) for f in vary}
    moved = {f: F.when(ahead[f] < F.col("__w"), drawn[f]).otherwise(F.col(f)) for f in vary}
    span = {f: (ranges[f"hi_{f}"] - ranges[f"lo_{f}"]) or 1.0 for f in vary}
    new = cand.select("id", "try", *[F.col(f).alias(f"__0_{f}") for f in vary],
                      *[moved[f].alias(f) if f in vary else F.col(f) for f in features])
    new = new.withColumn("distance", sum((F.abs(F.col(f) - F.col(f"__0_{f}")) / F.lit(span[f]) for f in vary), F.lit(0.0)))
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(new)
    scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    hit = F.col("score") < threshold if desired_class == 0 else F.col("score") >= threshold
    hit = F.coalesce(hit & ~F.isnan("score"), F.lit(False))
    # the first try stays as the row's own mark when nothing hits
    found = scored.withColumn("found", hit).where("found or try = 1").select(
        "id", "try", "distance", "score", "found", *features)
    w = Window.partitionBy("id").orderBy(F.desc("found"), "distance", "try")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(
        (F.col("rank") <= k) & (F.col("found") | (F.col("rank") == 1)))
    return ranked.select("id", *[F.when(F.col("found"), F.col(c)).alias(c) for c in ("rank", "distance", "score")],
                         "found", *[F.when(F.col("found"), F.col(f)).alias(f) for f in features])


def change_report(df: DataFrame, cf: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """What has to change: best counterfactual against the original, differing features only."""
    best = cf.where("rank = 1").select("id", *[F.col(f).alias(f"__cf_{f}") for f in features])
    both = df.select(F.col(id_col).alias("id"), *features).join(best, "id")
    pairs = F.array(*[
        F.when(differs(f, f"__cf_{f}"), F.struct(
            F.lit(f).alias("parameter"), format_value(f).alias("current_value"),
            format_value(f"__cf_{f}").alias("target_value"))) for f in features])
    return both.select("id", F.inline(F.filter(pairs, lambda x: x.isNotNull())))
