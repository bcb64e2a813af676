"""Order-dependent primitives that never funnel a global order through one task.

A window without PARTITION BY runs in a single task.  Running sums here work on a frame that
is already aggregated to one row per key, cut into key ranges of about equal row count:

1. quantile bounds of the key (a bounded array) come from one partial aggregate,
2. every row finds its range by binary search, as plain generated code,
3. windows run inside a range, and the (at most ranges x groups) range totals give the offset.

All branches read the aggregated frame with the same columns, so Spark shuffles it once per step
and reuses the exchange; windows and totals read the very same ranged shuffle output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

MIN_RANGES, MAX_RANGES = 8, 4096
_RANGE = "__range"


def range_count(df: DataFrame) -> int:
    """Number of key ranges: one per shuffle partition, within fixed limits."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_RANGES, min(MAX_RANGES, parts))


def sorted_position(df: DataFrame, bounds: Column, key: Column, n_max: int, out: str,
                    inclusive: bool = False) -> DataFrame:
    """Add ``out`` = how many entries of the sorted array ``bounds`` are < key (<= if inclusive).

    Binary lifting over at most ``n_max`` entries: log2(n_max) generated comparisons per row.
    """
    arr, k = f"{out}__a", f"{out}__k"
    res = df.withColumn(arr, bounds).withColumn(k, key).withColumn(out, F.lit(0))
    step = 1 << (n_max.bit_length() - 1) if n_max > 0 else 0
    while step:
        probe = F.get(F.col(arr), F.col(out) + F.lit(step - 1))
        hit = probe <= F.col(k) if inclusive else probe < F.col(k)
        res = res.withColumn(out, F.col(out) + F.when(hit, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return res.drop(arr, k)


def _check(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    """Checksum over a frame's columns.

    It only makes a side branch read the same columns as the main branch, so that both share one
    exchange instead of shuffling (and scanning) again with fewer columns.
    """
    return F.bit_xor(F.xxhash64(*[c for c in df.columns if c not in skip])).alias("__chk")


def assign_ranges(pre: DataFrame, key: str, by: Sequence[str] = (), shared_bounds: bool = True,
                  ranges: int | None = None) -> DataFrame:
    """Add a range number that rises with ``key`` and partition the rows by (by, range).

    Ranges hold about equally many rows.  ``shared_bounds`` uses one set of bounds for all groups;
    otherwise each group gets its own, and the groups must be few by construction (a feature list).
    """
    n = ranges or range_count(pre)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    # bounds only balance the ranges, so a rank error of half a range is fine and the sketches
    # that meet in the final task stay small
    bounds = F.struct(F.percentile_approx(key, probs, F.lit(max(2_000, 2 * n))).alias("b"),
                      _check(pre)).alias("__s")
    if shared_bounds or not by:
        ranged = sorted_position(pre, pre.agg(bounds).scalar()["b"], F.col(key), n - 1, _RANGE)
    else:
        # the condition, always true, keeps the checksum and with it the shared exchange
        per_group = pre.groupBy(*by).agg(bounds).where("__s.__chk is not null")
        joined = pre.join(F.broadcast(per_group), list(by), "inner")
        ranged = sorted_position(joined, F.col("__s")["b"], F.col(key), n - 1, _RANGE).drop("__s")
    return ranged.repartition(*by, _RANGE)


def running_sums(pre: DataFrame, key: str, sums: dict[str, str], by: Sequence[str] = (),
                 descending: bool = False, shared_bounds: bool = True,
                 small_groups: bool = True, ranges: int | None = None,
                 keep_range: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums over ``key`` order within ``by``; ``sums`` maps input -> output.

    ``totals`` also adds the group total of summed columns, which the range totals give for free.

    ``pre`` holds one row per (by, key).  The result of a call with ``keep_range`` can be passed in
    again; it is not ranged (and not shuffled) twice.  ``small_groups`` says that the range totals
    (ranges x groups rows) are few by construction and may be broadcast; otherwise they are joined
    by shuffle.
    """
    by, cols, totals = list(by), list(sums), totals or {}
    if _RANGE not in pre.columns:
        pre = assign_ranges(pre, key, by, shared_bounds, ranges)
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (Window.partitionBy(*by, _RANGE).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = pre.select("*", *[F.sum(c).over(inside).alias(f"__l_{c}") for c in cols])

    # ranges rise with the key, so their order is the order of their largest key
    per_range = pre.groupBy(*by, _RANGE).agg(
        F.max(key).alias("__top"), _check(pre, [*by, _RANGE]),
        *[F.sum(c).alias(f"__s_{c}") for c in cols])
    range_order = F.col("__top").desc() if descending else F.col("__top").asc()
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy(range_order, "__chk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, _RANGE,
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in cols],
        *[F.sum(f"__s_{c}").over(group).alias(out) for c, out in totals.items()])
    right = F.broadcast(offsets) if small_groups else offsets
    out = local.join(right, [*by, _RANGE], "inner")
    return out.select(
        *by, *([_RANGE] if keep_range else []),
        *[c for c in pre.columns if c not in (*by, _RANGE)],
        *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(o) for c, o in sums.items()], *totals.values())


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "area") -> DataFrame:
    """Trapezoid integral of ``y`` over ``x`` for short curves (horizon grids, bin tables)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(x)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    parts = df.select(*by, ((F.col(x) - px) * (F.col(y) + py) / 2).alias("__p"))
    return parts.groupBy(*by).agg(F.coalesce(F.sum("__p"), F.lit(0.0)).alias(out))


def step_lookup(points: DataFrame, at: str, curve: DataFrame, t: str, value: str,
                default: float = 1.0, out: str | None = None) -> DataFrame:
    """As-of lookup: last ``value`` of ``curve`` with ``t`` <= ``at``; ``default`` before the first.

    Works at any curve size: distinct lookup times and curve times are merged, ranged, and the
    last value is carried inside a range and across ranges.  ``points`` joins back on ``at``.
    """
    out = out or value
    steps = curve.select(F.col(t).cast("double").alias("__k"),
                         F.col(value).cast("double").alias("__v"))
    asks = points.select(F.col(at).cast("double").alias("__k"),
                         F.lit(None).cast("double").alias("__v")).where("__k is not null")
    # one row per time: a curve row and any questions at the same time fold into one
    merged = steps.unionByName(asks).groupBy("__k").agg(F.max("__v").alias("__v"))
    ranged = assign_ranges(merged, "__k")
    inside = (Window.partitionBy(_RANGE).orderBy("__k")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = ranged.select("__k", _RANGE, F.last("__v", ignorenulls=True).over(inside).alias("__in"))
    known_at = F.when(F.col("__v").isNotNull(), F.col("__k"))
    ends = ranged.groupBy(_RANGE).agg(F.max_by("__v", known_at).alias("__e"))
    prior = Window.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(_RANGE, F.last("__e", ignorenulls=True).over(prior).alias("__pre"))
    looked = carried.join(F.broadcast(ends), _RANGE).select(
        "__k", F.coalesce("__in", "__pre", F.lit(default)).alias(out))
    base = points.withColumn("__k", F.col(at).cast("double"))
    return base.join(looked, "__k", "left").drop("__k")


def text_ranks(df: DataFrame, by: str, text: str, out: str = "rank") -> DataFrame:
    """0-based rank of the distinct texts of each group, in byte order, at any number of texts.

    The rows are sorted across partitions and numbered inside each; the numbered rows are
    checkpointed, so that the partition offsets (one row per partition) fit them in every case.
    """
    numbered = df.select(by, text).distinct().orderBy(by, text).select(
        by, text, F.monotonically_increasing_id().alias("__m"))
    numbered = cut_lineage(numbered).withColumns({
        "__part": F.shiftright("__m", 33), "__pos": F.col("__m").bitwiseAND((1 << 33) - 1)})
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__off"))
    placed = numbered.join(F.broadcast(offsets), "__part").select(
        by, text, (F.col("__pos") + F.col("__off")).alias("__rank"))
    first = placed.groupBy(by).agg(F.min("__rank").alias("__first"))
    # one row per group, and groups are columns of a frame: few by construction
    return placed.join(F.broadcast(first), by).select(by, text, (F.col("__rank") - F.col("__first")).alias(out))


def exact_quantiles(pre: DataFrame, key: str, count: str, probs: Sequence[float],
                    by: Sequence[str] = (), out: str = "quantiles") -> DataFrame:
    """Exact linear-interpolation quantiles per group from a (by, key, count) frame.

    Groups must be few (a column list).  Only running counts are shuffled; no task ever holds
    the distinct values of a group.  Returns one row per group: by, n, ``out`` array.
    """
    pre = pre.select(*by, key, count)
    cum = running_sums(pre, key, {count: "__cum"}, by=by, shared_bounds=not by, totals={count: "__n"})
    found = cum.groupBy(*by).agg(F.max("__n").alias("n"), *order_statistics(key, count, "__cum", "__n", probs))
    return found.select(*by, "n", interpolated("n", probs).alias(out))


def order_statistics(key: str, count: str, cum: str, total: str, probs: Sequence[float]) -> list[Column]:
    """Aggregates that pick, for each quantile, the values at the two neighbouring positions."""
    first, last, aggs = F.col(cum) - F.col(count), F.col(cum), []
    for i, p in enumerate(probs):
        pos = (F.col(total) - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= idx) & (idx < last), F.col(key))).alias(f"__{side}{i}"))
    return aggs


def interpolated(total: str, probs: Sequence[float]) -> Column:
    """Array of linearly interpolated quantiles from the ``order_statistics`` columns."""
    out = []
    for i, p in enumerate(probs):
        pos = (F.col(total) - 1) * F.lit(float(p))
        frac, lo, hi = pos - F.floor(pos), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        value = (F.when(lo == hi, lo).when(frac < 0.5, lo + (hi - lo) * frac)
                 .otherwise(hi - (hi - lo) * (1 - frac)))
        out.append(value.cast("double"))
    return F.array(*out)
