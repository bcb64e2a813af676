"""Spark ML's gradient-boosted classification trees, fitted over blocks of byte bins.

The trees are those of ``GBTClassifier`` with log loss: the same sampled split candidates, variance gain,
stopping rules and order of sums in a partition; what is returned is an ordinary ``GBTClassificationModel``.
Spark's own fit keeps an object a row and walks it for every level of every tree.  Here a row is a byte per
feature, a byte for its label and eight for its prediction so far, in blocks of ``BLOCK`` rows that Spark keeps (in
memory, else on disk); a level is one job of one stage that sums rows, residuals and squared residuals per
(node, feature, bin).  The driver sees only these sums, whose number is set by depth, features and bins.

Predictions are carried on once a tree, in the job that sums its first level, and checkpointed every
``CHECKPOINT`` trees.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.boosting import BLOCK, MASK_DEPTH, MISSING, HistTree, LeafMasks
from riskframe.session import ensure_checkpoint_dir

# settings this fit knows; others are left to Spark's own
SETTINGS = {"featuresCol", "labelCol", "maxIter", "maxDepth", "stepSize", "seed", "maxBins"}
LEAST_SAMPLE = 10_000
EPSILON = float(np.finfo(float).eps)
CHECKPOINT = 10
# rows of a task, unless fewer tasks would leave cores without one
TASK_ROWS = 1 << 20
# more tasks' sums than these are added up in tasks first
DIRECT_PARTS = 256


def split_points(values: np.ndarray, max_splits: int, expected: float) -> np.ndarray:
    """Split candidates of a feature from its sampled values, at even strides of their counts.

    Zeros are counted as what the other values leave of the ``expected`` rows.
    """
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.empty(0)
    counts, zeros = counts.astype(float), expected - counts.sum()
    if zeros > EPSILON * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, zeros)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= max_splits:
        return middles
    stride = expected / (max_splits + 1)
    points, target, reached = [], stride, counts[0]
    for middle, count in zip(middles, counts[1:]):
        before, reached = reached, reached + count
        if abs(before - target) < abs(reached - target):
            points.append(middle)
            target += stride
    return np.array(points)


def find_splits(df: DataFrame, features: str, rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Split candidates per feature from the rows that Spark ML samples, all rows of small frames."""
    spark = df.sparkSession
    wanted, bins = max(min(max_bins, rows) ** 2, LEAST_SAMPLE), min(max_bins, rows)
    fraction = wanted / rows if wanted < rows else 1.0
    vectors = df.select(F.col(features).alias("v"))
    if fraction < 1:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = vectors._jdf.rdd().sample(False, fraction, draw)
        vectors = DataFrame(spark._jsparkSession.createDataFrame(drawn, vectors._jdf.schema()), spark)
    values = np.array([r[0] for r in vectors.select(vector_to_array("v")).collect()], float)
    return [split_points(column, bins - 1, fraction * rows) for column in values.T]


def _blocks(df: DataFrame, features: str, label: str, splits: Sequence[np.ndarray]) -> RDD:
    """(labels of 1 and -1, predictions, bins as features x rows) of up to ``BLOCK`` rows, as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(n: int) -> pa.RecordBatch:
            sign, bins = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], 1)
            held[:] = [(sign[n:], bins[:, n:])]
            return pa.RecordBatch.from_pydict({"sign": [sign[:n].tobytes()], "bins": [bins[:, :n].tobytes()]})

        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(splits))
            bins = [np.searchsorted(points, column, side="left") for points, column in zip(splits, values.T)]
            held.append(((2 * batch.column(0).to_numpy() - 1).astype(np.int8), np.array(bins, np.uint8).reshape(len(splits), -1)))
            size += batch.num_rows
            while size >= BLOCK:
                yield out(BLOCK)
                size -= BLOCK
        if size:
            yield out(size)

    rows = df.select(F.col(label).cast("double"), vector_to_array(features))
    return rows.mapInArrow(run, "sign binary, bins binary").rdd.map(lambda r: (bytes(r[0]), bytes(8 * len(r[0])), bytes(r[1])))


def _arrays(block: tuple[bytes, bytes, bytes], p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign, prediction, bins = block
    return np.frombuffer(sign, np.int8), np.frombuffer(prediction, np.float64), np.frombuffer(bins, np.uint8).reshape(p, -1)


# of exp: 64 / log(2) and its inverse in two parts, terms of its series, 2^(j/64) rounded down and what that leaves
_PER_STEP, _STEP_HIGH, _STEP_LOW = (float.fromhex(x) for x in (
    "0x1.71547652b82fep+6", "0x1.62e42fefap-7", "0x1.cf79abc9e3b3ap-46"))
_TERMS = [float.fromhex(x) for x in (
    "0x1.ffffffffffffep-2", "0x1.5555555548ba1p-3", "0x1.55555555b9e25p-5", "0x1.11115c090cf0fp-7", "0x1.6c15ce3289860p-10")]
with localcontext(prec=50):
    _POWERS = [Decimal(2) ** (Decimal(j) / 64) for j in range(64)]
    _DOWN = np.array([f if f <= x else np.nextafter(f, 0.0) for x in _POWERS for f in (float(x),)])
    _LEFT = np.array([float(x / Decimal(float(down)) - 1) for x, down in zip(_POWERS, _DOWN)])


def java_exp(x: np.ndarray) -> np.ndarray:
    """exp to the last bit as the JVM has it on x86; numpy's differs there for one value in twenty.

    Residuals of other last bits would choose otherwise among features that part a node's rows alike.
    """
    if len(x) and max(-x.min(), x.max()) > 700.0:
        return np.exp(x.astype(np.longdouble)).astype(float)
    t2, t3, t4, t5, t6 = _TERMS
    steps = np.rint(x * _PER_STEP)
    y = (x - steps * _STEP_HIGH) - steps * _STEP_LOW
    steps = steps.astype(np.int64)
    at = steps & 63
    power = _DOWN.take(at) * (((steps >> 6) + 1023) << 52).view(np.float64)
    y2 = y * y
    y3 = y * y2
    rest = (y3 * (t3 + t4 * y) + ((y + _LEFT.take(at)) + y3 * y2 * (t5 + t6 * y))) + y2 * t2
    return rest * power + power


def _impurity(stats: np.ndarray) -> np.ndarray:
    """Variance of (rows, sum, sum of squares)."""
    n, total, squares = np.moveaxis(stats, -1, 0)
    some = np.where(n == 0, 1.0, n)
    return np.where(n == 0, 0.0, (squares - total * total / some) / some)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    left: np.ndarray
    right: np.ndarray


def best_split(sums: np.ndarray, sizes: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, Split | None]:
    """(the node's stats, its best split or None): of equal gains the first feature, then the first cut counts.

    ``sums`` is (feature, bin, 3); ``own`` has the stats that the split above gave the node.
    """
    below = np.cumsum(sums, 1)
    cuts = below.shape[1] - 1
    total = below[np.arange(len(sizes)), sizes][:, None]
    left = below[:, :cuts]
    right = total - left
    usable = np.arange(cuts) < sizes[:, None]
    if own is None:
        with_cuts = np.flatnonzero(sizes)
        own = left[with_cuts[0], 0] + right[with_cuts[0], 0] if len(with_cuts) else below[0, -1]
    n = left[..., 0] + right[..., 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = _impurity(own) - left[..., 0] / n * _impurity(left) - right[..., 0] / n * _impurity(right)
    fits = usable & (left[..., 0] >= 1) & (right[..., 0] >= 1) & (gain >= 0.0)
    if not fits.any():
        return own, None
    f, cut = divmod(int(np.argmax(np.where(fits, gain, -np.inf))), cuts)
    return own, Split(float(gain[f, cut]), f, cut, left[f, cut], right[f, cut])


class VarianceTree:
    """A growing regression tree in heap order, with the stats of its nodes."""

    def __init__(self, depth: int) -> None:
        self.shape = HistTree.empty(depth)
        self.stats = np.zeros((len(self.shape.feature), 3))
        self.valid = np.ones(len(self.shape.feature), bool)
        self.open = [0]

    def grow(self, level: int, depth: int, sums: np.ndarray, sizes: np.ndarray) -> None:
        """Splits the open nodes, whose sums these are."""
        children = []
        for i, node_sums in zip(self.open, sums):
            self.stats[i], split = best_split(node_sums, sizes, self.stats[i] if level else None)
            self.valid[i] = split is not None
            if split is None or split.gain <= 0:
                continue
            self.shape.gain[i], self.shape.feature[i], self.shape.cut[i] = split.gain, split.feature, split.cut
            for child, stats in ((2 * i + 1, split.left), (2 * i + 2, split.right)):
                self.stats[child] = stats
                if level + 1 < depth and abs(_impurity(stats)) >= EPSILON:
                    children.append(child)
        self.open = children

    def finished(self) -> HistTree:
        n, total = self.stats[:, 0], self.stats[:, 1]
        self.shape.value[:] = np.where(n == 0, 0.0, total / np.where(n == 0, 1.0, n))
        return self.shape


def _level_sums(blocks: RDD, tree: VarianceTree, p: int, width: int, first_tree: bool) -> np.ndarray:
    """(open node, feature, bin, 3): rows, residuals and their squares; few parts are added in order."""
    count, missing = len(tree.open), [MISSING] * p
    masks, rank = None, None
    if tree.open != [0]:
        masks, places = LeafMasks([tree.shape], missing), {i: k for k, i in enumerate(tree.open)}
        rank = np.array([places.get(i, -1) for i in masks.places[0].tolist()])

    def run(part: Iterable[tuple]) -> Iterator[np.ndarray]:
        sums, size = np.zeros((3, p, count * width)), count * width
        for block in part:
            sign, prediction, bins = _arrays(block, p)
            # residuals of log loss; the first tree is fitted to the labels
            rest = sign.astype(float) if first_tree else 4.0 * sign / (1.0 + java_exp(2.0 * sign * prediction))
            if masks is None:
                start = np.zeros(len(rest), np.intp)
            else:
                start = rank.take(masks.at(bins)[0])
                if start.min() < 0:
                    live = np.flatnonzero(start >= 0)
                    start, rest, bins = start.take(live), rest.take(live), bins.take(live, 1)
                start *= width
            squares = rest * rest
            for k in range(p):
                cell = start + bins[k]
                sums[0, k] += np.bincount(cell, minlength=size)
                sums[1, k] += np.bincount(cell, rest, size)
                sums[2, k] += np.bincount(cell, squares, size)
        yield sums

    parts = blocks.mapPartitions(run)
    found = parts.collect() if parts.getNumPartitions() <= DIRECT_PARTS else [parts.treeReduce(np.add)]
    total = np.zeros((3, p, count * width))
    for sums in found:
        total += sums
    return total.reshape(3, p, count, width).transpose(2, 1, 3, 0)


def _carried(blocks: RDD, tree: HistTree, weight: float, p: int) -> RDD:
    """Blocks with the tree's weighted values added to their predictions."""
    masks = LeafMasks([tree], [MISSING] * p)
    value = masks.place_value[0] * weight

    def run(part: Iterable[tuple]) -> Iterator[tuple]:
        for block in part:
            _, prediction, bins = _arrays(block, p)
            yield block[0], (prediction + value.take(masks.at(bins)[0])).tobytes(), block[2]

    return blocks.mapPartitions(run, preservesPartitioning=True)


def _spark_model(estimator: GBTClassifier, trees: Sequence[VarianceTree], splits: Sequence[np.ndarray],
                 weights: Sequence[float], sc: Any) -> GBTClassificationModel:
    """The trees as Spark ML's model; a split whose leaves predict alike is one leaf, as there."""
    jvm, gateway = sc._jvm, sc._gateway
    # looked up once: each look-up asks the JVM
    nodes, part_of = jvm.org.apache.spark.ml.tree, jvm.java.util.Arrays.copyOfRange
    leaf, inner, cut_at = nodes.LeafNode, nodes.InternalNode, nodes.ContinuousSplit
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def doubles(values: Sequence[float]) -> Any:
        out = gateway.new_array(jvm.double, len(values))
        jvm.java.nio.ByteBuffer.wrap(bytearray(struct.pack(f">{len(values)}d", *values))).asDoubleBuffer().get(out)
        return out

    def root(t: VarianceTree) -> Any:
        shape, stats = t.shape, doubles(t.stats.ravel().tolist())
        impurity = _impurity(t.stats).tolist()

        def node(i: int) -> tuple[Any, float | None]:
            """The node, and its prediction if it is a leaf."""
            own = calculator(part_of(stats, 3 * i, 3 * i + 3), int(t.stats[i, 0]))
            value, f = float(shape.value[i]), int(shape.feature[i])
            if f < 0:
                return leaf(value, impurity[i] if t.valid[i] else -1.0, own), value
            (left, a), (right, b) = node(2 * i + 1), node(2 * i + 2)
            if a is not None and a == b:
                return leaf(a, impurity[i], own), a
            cut = cut_at(f, float(splits[f][shape.cut[i]]))
            return inner(value, impurity[i], float(shape.gain[i]), left, right, cut, own), None

        return node(0)[0]

    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(kind, len(trees))
    for k, t in enumerate(trees):
        array[k] = kind(root(t), len(splits))
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(estimator.uid, array, doubles(weights), len(splits), 2)
    return estimator._copyValues(GBTClassificationModel(made))


def _known(estimator: GBTClassifier, df: DataFrame, features: str) -> bool:
    """Whether this fit covers the settings and the features' kinds."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return ({p.name for p in estimator._paramMap} <= SETTINGS and not {"nominal", "binary"} & set(attrs)
            and 2 <= estimator.getMaxBins() <= MISSING and 1 <= estimator.getMaxDepth() <= MASK_DEPTH)


def fit_gradient_trees(df: DataFrame, estimator: GBTClassifier) -> GBTClassificationModel:
    """``estimator.fit(df)``; what is not covered here, errors on bad rows included, is left to that."""
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    if not _known(estimator, df, features):
        return estimator.fit(df)
    sc = df.sparkSession.sparkContext
    x, y = vector_to_array(features), F.col(label).cast("double")
    wrong = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))) | ~y.isin(0.0, 1.0)
    n, p, fewest, bad = df.agg(F.count(F.lit(1)), F.max(F.size(x)), F.min(F.size(x)),
                               F.count(F.when(F.coalesce(wrong, F.lit(True)), 1))).first()
    if not n or bad or not p or p != fewest:
        return estimator.fit(df)
    splits = find_splits(df, features, n, estimator.getMaxBins(), estimator.getSeed())
    sizes = np.array([len(s) for s in splits])
    width, depth = int(sizes.max()) + 1, estimator.getMaxDepth()
    ensure_checkpoint_dir(df.sparkSession)
    blocks = _blocks(df, features, label, splits)
    tasks = max(sc.defaultParallelism, -(-n // TASK_ROWS))
    if blocks.getNumPartitions() > tasks:
        blocks = blocks.coalesce(tasks)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[VarianceTree] = []
    weights: list[float] = []
    try:
        for number in range(estimator.getMaxIter()):
            before = None
            if trees:
                before, blocks = blocks, _carried(blocks, trees[-1].shape, weights[-1], p).persist(StorageLevel.MEMORY_AND_DISK)
                if number % CHECKPOINT == 0:
                    blocks.checkpoint()
            tree = VarianceTree(depth)
            for level in range(depth):
                tree.grow(level, depth, _level_sums(blocks, tree, p, width, not trees), sizes)
                if before is not None:
                    before.unpersist()
                    before = None
                if not tree.open:
                    break
            tree.finished()
            trees.append(tree)
            weights.append(estimator.getStepSize() if number else 1.0)
    finally:
        blocks.unpersist()
    return _spark_model(estimator, trees, splits, weights, sc)
