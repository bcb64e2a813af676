"""Second-order histogram boosting for a binary label.

Rows become one written table of blocks of ``BLOCK`` rows (labels, margins, bins): a byte per feature, whose
cut points come from mergeable sketches of all features in one aggregate.  A tree grows level by level; a
level is one Spark job that sums gradient, Hessian and rows per (node, feature, bin) in the tasks and adds the
tasks' sums up.  The driver sees only these sums, whose number is set by depth, features and bins, and picks
per node the split of the highest gain, trying missing values on both sides.  Of two children only the one
with fewer rows is summed; the other has what is left of their parent's sums.

Gradients and Hessians are summed as whole multiples of 2^-24, so the sums, and with them the trees, do not
depend on how Spark deals out or retries the rows.  Margins are carried on by a written table every
``REFRESH`` trees; in between a row's margin is that plus the few trees since.

A row's leaf comes without walking the tree: every (feature, bin) has one bit per leaf that says whether the
bin may lead there, and the leaf is the bit that all the row's features have.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

# fixed values: default model parameters
N_TREES, DEPTH, RATE, L2, MIN_HESSIAN, MIN_GAIN = 100, 5, 0.05, 1.0, 1.0, 0.0
MAX_BINS = 64
SKETCH_ACCURACY = 10_000
REFRESH = 10
MISSING = 255
UNIT = 1 << 24
# rows of a block: sums of 2^14 rows with a Hessian of at most 2^22 units leave room for the row count in a double
BLOCK = 1 << 14
PACK = float(1 << 37)
MASK_DEPTH = 6
DIRECT_PARTS = 32
STATE_SCHEMA = "label binary, margin binary, bins binary"
_STATE = pa.schema([("label", pa.binary()), ("margin", pa.binary()), ("bins", pa.binary())])


def fit_cuts(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Cut points per feature at even ranks (rank error rows / ``SKETCH_ACCURACY``), in one aggregate.

    A value goes left of a cut when it is at most the cut.  NULL and NaN have no rank; a feature without values
    has no cut.
    """
    if not 2 <= max_bins <= MISSING:
        raise ValueError(f"bins must be between 2 and {MISSING}")
    ranks = [i / max_bins for i in range(1, max_bins)]
    def valued(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.when(~F.isnan(x), x)

    row = df.agg(*[F.percentile_approx(valued(f), ranks, SKETCH_ACCURACY).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(row[f"c{i}"] or [])) for i in range(len(features))]


def to_bins(values: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bytes (rows x features): how many cuts a value is above, or ``MISSING``."""
    out = np.empty(values.shape, np.uint8)
    for k, points in enumerate(cuts):
        found = np.searchsorted(np.array(points, float), values[:, k], side="left")
        out[:, k] = np.where(np.isnan(values[:, k]), MISSING, found)
    return out


@dataclass(frozen=True)
class HistTree:
    """A tree in heap order (children of i are 2i + 1 and 2i + 2); ``feature`` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    hessian: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> HistTree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n),
                   np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[node]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == MISSING, self.missing_left[node], b <= self.cut[node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


class LeafMasks:
    """Bits of the last-level places that each (feature, bin) may lead to, for all trees at once.

    ``missing`` is each feature's bin of missing values.  A leaf above the last level owns all places below it.
    Places go by the number that a multiplication makes of their bit.
    """

    def __init__(self, trees: Sequence[HistTree], missing: Sequence[int]) -> None:
        self.depth = max(((len(t.feature) + 1).bit_length() - 2 for t in trees), default=0)
        if self.depth > MASK_DEPTH:
            raise ValueError(f"masks have room for depth {MASK_DEPTH}")
        # de Bruijn sequences: the top bits of their product with a power of two tell which one it is
        kind, size, self.factor = (np.uint64, 64, 0x03F79D71B4CB0A89) if self.depth > 5 else (np.uint32, 32, 0x077CB531)
        self.factor, self.shift = kind(self.factor), kind(size - size.bit_length() + 1)
        with np.errstate(over="ignore"):
            name = ((kind(1) << np.arange(1 << self.depth, dtype=kind)) * self.factor >> self.shift).astype(np.intp)
        full = (1 << (1 << self.depth)) - 1
        self.masks = np.full((len(missing), MISSING + 1, len(trees)), full, kind)
        self.place_value = np.zeros((len(trees), size))
        self.places = np.zeros((len(trees), size), np.int64)  # the node of a place
        for number, t in enumerate(trees):
            bits, stack = np.arange(MISSING + 1), [(0, 0, 1 << self.depth)]
            while stack:
                i, a, b = stack.pop()
                f = int(t.feature[i])
                if f < 0:
                    self.place_value[number, name[a:b]], self.places[number, name[a:b]] = t.value[i], i
                    continue
                mid = (a + b) // 2
                left = bits <= t.cut[i]
                left[missing[f]] = t.missing_left[i]
                column = self.masks[f, :, number]
                column[left] &= kind(full ^ (((1 << (b - mid)) - 1) << mid))
                column[~left] &= kind(full ^ (((1 << (mid - a)) - 1) << a))
                stack += [(2 * i + 1, a, mid), (2 * i + 2, mid, b)]

    def at(self, bins: np.ndarray) -> np.ndarray:
        """(trees x rows): the place of each row, the first of its leaf's; ``bins`` is features x rows."""
        if not len(self.masks):
            return np.zeros((self.masks.shape[2], bins.shape[1]), np.intp)
        met = self.masks[0].take(bins[0], axis=0)
        for mask, column in zip(self.masks[1:], bins[1:]):
            met &= mask.take(column, axis=0)
        met &= ~met + met.dtype.type(1)  # the lowest bit
        met *= self.factor
        met >>= self.shift
        return met.T.astype(np.intp, order="C")

    def total(self, place: np.ndarray) -> np.ndarray:
        """Per row the sum of its places' values, added tree by tree."""
        out = np.zeros(place.shape[1])
        for value, at in zip(self.place_value, place):
            out += value.take(at)
        return out


def tree_total(trees: Sequence[HistTree], bins: np.ndarray, missing: Sequence[int]) -> np.ndarray:
    """Per row the sum of the trees' values; ``bins`` is features x rows."""
    if not trees:
        return np.zeros(bins.shape[1])
    if max(len(t.feature) for t in trees) < 2 << MASK_DEPTH:
        masks = LeafMasks(trees, missing)
        return masks.total(masks.at(bins))
    rows = _marked(bins, missing)
    return sum((t.values(rows) for t in trees), np.zeros(len(rows)))


def _marked(bins: np.ndarray, missing: Sequence[int]) -> np.ndarray:
    """Bins as rows x features, with ``MISSING`` for each feature's bin of missing values."""
    return np.where(bins == np.array(missing, np.uint8)[:, None], MISSING, bins).astype(np.uint8).T


@dataclass(frozen=True)
class HistModel:
    """Cut points, base margin and trees; ``features`` names the columns in order."""

    features: tuple[str, ...]
    cuts: list[list[float]]
    base_margin: float
    trees: list[HistTree] = field(default_factory=list)

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = np.ascontiguousarray(to_bins(values, self.cuts).T)
        return self.base_margin + tree_total(self.trees, bins, [MISSING] * len(self.cuts))

    def leaves(self) -> list[tuple]:
        """Leaves as (value, features, boxes, shares): a box is (lo, hi] and whether missing values are in it,
        a share the part of the training rows that goes the path's way at its feature."""
        out = [(self.base_margin, [], [], [])]
        for t in self.trees:
            stack = [(0, {}, {})]
            while stack:
                i, box, share = stack.pop()
                if t.feature[i] < 0:
                    feats = sorted(box)
                    out.append((float(t.value[i]), feats, [box[f] for f in feats], [share[f] for f in feats]))
                    continue
                f, points = int(t.feature[i]), self.cuts[t.feature[i]]
                point = points[t.cut[i]] if t.cut[i] < len(points) else np.inf
                lo, hi, missing = box.get(f, (-np.inf, np.inf, True))
                to_left = bool(t.missing_left[i])
                for child, part in ((2 * i + 1, (lo, min(hi, point), missing and to_left)),
                                    (2 * i + 2, (max(lo, point), hi, missing and not to_left))):
                    stack.append((child, {**box, f: part}, {**share, f: share.get(f, 1.0) * t.rows[child] / max(t.rows[i], 1)}))
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "cuts": self.cuts, "base_margin": self.base_margin, "trees": [
            {k: v.tolist() for k, v in vars(t).items()} for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> HistModel:
        raw = json.loads(text)
        kinds = {k: v.dtype for k, v in vars(HistTree.empty(0)).items()}
        trees = [HistTree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in raw["trees"]]
        return cls(tuple(raw["features"]), raw["cuts"], raw["base_margin"], trees)


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns of a batch as a float matrix, NULL as NaN."""
    columns = [batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)]
    return np.stack(columns, 1) if columns else np.zeros((batch.num_rows, 0))


def _arrays(label: bytes, margin: bytes, bins: bytes, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, margins, bins) of a block; bins are features x rows."""
    return np.frombuffer(label, np.float64), np.frombuffer(margin, np.float64), np.frombuffer(bins, np.uint8).reshape(p, -1)


def _block(label: np.ndarray, margin: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (label, margin, bins)], schema=_STATE)


def _state(df: DataFrame, features: Sequence[str], label: str, cuts: list, base: float) -> DataFrame:
    """Blocks of binned training rows; rows without a label are left out.

    A missing value's bin is the one behind its feature's others.
    """
    missing = np.array([len(c) + 1 for c in cuts], np.uint8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bins = to_bins(_matrix(batch, 1, len(cuts)), cuts)
            held.append((batch.column(0).to_numpy(), np.where(bins == MISSING, missing, bins).astype(np.uint8).T))
            size += batch.num_rows
            if size >= BLOCK:
                label, bins = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], 1)
                for at in range(0, size - BLOCK + 1, BLOCK):
                    yield _block(label[at:at + BLOCK], np.full(BLOCK, base), bins[:, at:at + BLOCK])
                rest = size - size % BLOCK
                held, size = [(label[rest:], bins[:, rest:])], size - rest
        if size:
            yield _block(np.concatenate([h[0] for h in held]), np.full(size, base), np.concatenate([h[1] for h in held], 1))

    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    return cut_lineage(rows.mapInArrow(run, STATE_SCHEMA))


def _carried(state: DataFrame, trees: list[HistTree], sizes: Sequence[int]) -> DataFrame:
    """State with the trees' values added to its margins."""
    missing = [n - 1 for n in sizes]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in zip(*batch.columns):
                label, margin, bins = _arrays(*(x.as_buffer() for x in block), len(sizes))
                yield _block(label, margin + tree_total(trees, bins, missing), bins)

    return cut_lineage(state.mapInArrow(run, STATE_SCHEMA))


def level_sums(state: DataFrame, trees: list[HistTree], tree: HistTree, level: int, sizes: Sequence[int],
               above: np.ndarray | None = None) -> np.ndarray:
    """(node, cell, 3): gradient, Hessian and rows of each node of a level by feature and bin.

    A feature with k cuts has k + 1 bins and one for missing values.  One job over the state, each task with one
    array of sums; many tasks' arrays are added up in tasks first.
    With the sums of the level above only the child with fewer rows is summed of each split.
    """
    p, first, nodes = len(sizes), (1 << level) - 1, 1 << level
    starts = np.concatenate([[0], np.cumsum(sizes)])
    width = int(starts[-1])
    missing = [n - 1 for n in sizes]
    inner = np.arange(first, first + nodes)
    parents = tree.feature[(inner - 1) // 2] >= 0 if level else np.ones(1, bool)
    summed = parents.copy()
    if above is not None:
        rows = tree.rows[inner].reshape(-1, 2)
        fewer = rows[:, 1] < rows[:, 0]
        summed &= np.stack([~fewer, fewer], 1).ravel()
    rank = np.where(summed, np.cumsum(summed) - 1, -1)  # summed nodes in a row of their own
    count = int(summed.sum())

    def run(blocks: Iterable[tuple]) -> Iterator[np.ndarray]:
        sums = [np.zeros((3, count * n), np.int64) for n in sizes]
        depth = (len(tree.feature) + 1).bit_length() - 2
        masks = LeafMasks([*trees, tree], missing) if depth <= MASK_DEPTH else None
        if masks:
            # a place below a summed node has that node's rank; a leaf above the level has none
            of = ((masks.places[-1] + 1)[:, None] >> np.arange(depth + 1)) - 1
            place_rank = np.full(len(of), -1)
            for above in of.T:
                inside = (above >= first) & (above < first + nodes)
                place_rank[inside] = rank[above[inside] - first]
        for block in blocks:
            label, margin, bins = _arrays(*block, p)
            if masks:
                place = masks.at(bins)
                older = masks.total(place[:-1])
                node = place_rank.take(place[-1])
            else:
                older = tree_total(trees, bins, missing)
                walked = tree.nodes(_marked(bins, missing)) - first
                node = np.where(walked >= 0, rank[np.maximum(walked, 0)], -1)
            if level:
                live = np.flatnonzero(node >= 0)
                node, margin, label, older, bins = node[live], margin[live], label[live], older[live], bins[:, live]
            prob = 1.0 / (1.0 + np.exp(-(margin + older)))
            g = np.rint((prob - label) * UNIT)
            # whole numbers below 2^53: float sums of a block are exact, and rows share a double with Hessians
            h = np.rint(prob * (1.0 - prob) * UNIT) + PACK
            for k, n in enumerate(sizes):
                cell = node * n + bins[k]
                sums[k][0] += np.bincount(cell, g, count * n).astype(np.int64)
                packed = np.bincount(cell, h, count * n).astype(np.int64)
                sums[k][1] += packed & (int(PACK) - 1)
                sums[k][2] += packed >> 37
        yield np.concatenate([s.reshape(3, count, -1) for s in sums], 2)

    parts = state.rdd.mapPartitions(run)
    found = parts.treeReduce(np.add) if parts.getNumPartitions() > DIRECT_PARTS else parts.reduce(np.add)
    out = np.zeros((nodes, width, 3), np.int64)
    out[summed] = found.transpose(1, 2, 0)
    if above is not None:
        left = np.flatnonzero(parents & ~summed)
        out[left] = above[left // 2] - out[left ^ 1]
    return out


def best_split(sums: np.ndarray, sizes: Sequence[int], l2: float = L2, min_hessian: float = MIN_HESSIAN) -> tuple | None:
    """(gain, feature, cut, missing_left, left sums, right sums) of a node, or None without a split.

    Gain is half of G^2 / (H + l2) of the two sides less the node's.  Of equal gains the first feature,
    then the first cut, then missing values to the left count.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])
    best = None
    for f, (a, b) in enumerate(zip(starts, starts[1:])):
        cells, total = sums[a:b], sums[a:b].sum(0)
        below = np.cumsum(cells[:-1], 0)  # rows at most each cut, the last cut being all values there are
        for missing_left in (True, False):
            left = below + cells[-1] if missing_left else below
            right = total - left
            fits = (left[:, 2] > 0) & (right[:, 2] > 0) & (np.minimum(left[:, 1], right[:, 1]) >= min_hessian * UNIT)
            scores = [(s[:, 0] / UNIT) ** 2 / (s[:, 1] / UNIT + l2) for s in (left, right, total[None])]
            gain = np.where(fits, 0.5 * (scores[0] + scores[1] - scores[2]), -np.inf)
            k = int(np.argmax(gain))
            # a cut before or the other direction wins only by more than rounding
            if gain[k] > -np.inf and (best is None or gain[k] > best[0] + 1e-12 * abs(best[0])):
                best = (float(gain[k]), f, k, missing_left, left[k], right[k])
    return best


def fit_hist_boost(df: DataFrame, features: Sequence[str], label: str = "label", n_trees: int = N_TREES, depth: int = DEPTH,
                   rate: float = RATE, l2: float = L2, min_hessian: float = MIN_HESSIAN, min_gain: float = MIN_GAIN,
                   max_bins: int = MAX_BINS, cuts: list[list[float]] | None = None, base_margin: float | None = None) -> HistModel:
    """Fit; ``cuts`` and ``base_margin`` (default: the log odds of the label's mean) may be given.

    NULL and NaN are missing values; rows with a NULL label are left out; without rows, or with one label
    only, the model is its base margin (odds are kept within 1e-6).
    """
    features = tuple(features)
    cuts = fit_cuts(df, features, max_bins) if cuts is None else [sorted(map(float, c)) for c in cuts]
    n, mean = df.agg(F.count(label), F.avg(F.col(label).cast("double"))).first()
    if base_margin is None:
        mean = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
        base_margin = float(np.log(mean / (1 - mean)))
    state = _state(df, features, label, cuts, base_margin)
    sizes = [len(c) + 2 for c in cuts]
    trees: list[HistTree] = []
    recent: list[HistTree] = []
    for number in range(n_trees if n and features else 0):
        if len(recent) == REFRESH:
            state, recent = _carried(state, recent, sizes), []
        tree = HistTree.empty(depth)
        open_nodes, sums = {0}, None
        for level in range(depth):
            sums = level_sums(state, recent, tree, level, sizes, sums)
            if level == 0:
                whole = sums[0, :sizes[0]].sum(0)
                tree.rows[0], tree.hessian[0] = whole[2], whole[1] / UNIT
                tree.value[0] = -rate * whole[0] / UNIT / (whole[1] / UNIT + l2)
            children = set()
            for i in sorted(open_nodes):
                split = best_split(sums[i - (1 << level) + 1], sizes, l2, min_hessian)
                if split is None or split[0] <= min_gain:
                    continue
                tree.gain[i], tree.feature[i], tree.cut[i], tree.missing_left[i] = split[:4]
                for child, (g, h, rows) in zip((2 * i + 1, 2 * i + 2), split[4:]):
                    tree.rows[child], tree.hessian[child] = rows, h / UNIT
                    tree.value[child] = -rate * (g / UNIT) / (h / UNIT + l2)
                    children.add(child)
            open_nodes = children
            if not children:
                break
        trees.append(tree)
        recent.append(tree)
        if tree.feature[0] < 0 and abs(tree.value[0]) < 1e-9:
            break  # nothing left to learn
    return HistModel(features, cuts, base_margin, trees)


def score_hist_boost(df: DataFrame, model: HistModel, keep: Sequence[str] = (), out: str = "score",
                     margin: str | None = None) -> DataFrame:
    """Kept columns with the positive class's probability, and its margin where a name is given."""
    keep, p = list(keep), len(model.features)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is set by trees and depth
    names = [out, *([margin] if margin else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.margin(_matrix(batch, len(keep), p))
            columns = [1.0 / (1.0 + np.exp(-found)), *([found] if margin else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *map(pa.array, columns)], names=[*keep, *names])

    rows = df.select(*keep, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(model.features)])
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:len(keep)]] + [f"`{c}` double" for c in names])
    return rows.mapInArrow(run, schema)


def describe_trees(model: HistModel, spark: Any) -> DataFrame:
    """(tree, node, feature, cut, missing_left, gain, value, rows, hessian): the model as a small table."""
    rows = []
    for number, t in enumerate(model.trees):
        for i in np.flatnonzero(t.rows > 0).tolist():
            f = int(t.feature[i])
            points = model.cuts[f] if f >= 0 else []
            rows.append((number, i, model.features[f] if f >= 0 else None,
                         float(points[t.cut[i]]) if f >= 0 and t.cut[i] < len(points) else None,
                         bool(t.missing_left[i]) if f >= 0 else None, float(t.gain[i]) if f >= 0 else None,
                         float(t.value[i]), int(t.rows[i]), float(t.hessian[i])))
    return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, gain double, "
                                       "value double, rows long, hessian double")
