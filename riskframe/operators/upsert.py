"""Keep-latest dedup and partial-column upsert."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 tiebreak: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key: greatest ``order`` (NULLs last), ties by ``tiebreak``.

    The rank filter is pushed below the shuffle (window group limit): each map task sends at most
    one row per key, so a hot key never piles up in one task.
    """
    def desc(c: str | Column) -> Column:
        return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()

    w = Window.partitionBy(*keys).orderBy(*[desc(c) for c in [*order, *tiebreak]])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key occurs twice (the run stops, nothing is collected but one key)."""
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key in one batch: {dup[0].asDict()}")


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           order_col: str | None = None, ts_col: str | None = "loaded_at",
           now: datetime | Column | None = None, on_duplicate: str = "last") -> DataFrame:
    """Insert new keys whole; on a known key change only ``update_cols`` and the timestamp.

    Within a batch the rows of a key apply in ``order_col`` order: the first supplies the inserted
    columns, the last the updated ones.  An incoming NULL does overwrite.  Without ``order_col`` the
    rows of a key apply in the order of their values, so a key never comes out twice.
    ``on_duplicate="error"`` refuses a batch that names a key twice.
    """
    keys, update_cols = list(keys), list(update_cols)
    cols = [c for c in base.columns if c not in keys and c != ts_col]
    missing = [c for c in cols if c not in incoming.columns]
    if missing:
        raise ValueError(f"incoming rows lack columns {missing}")
    if on_duplicate == "error":
        assert_unique(incoming, keys)
    insert_cols = [c for c in cols if c not in update_cols]
    stamp = now if isinstance(now, Column) else F.lit(now).cast("timestamp")

    if on_duplicate == "error" and order_col is None:
        batch = incoming.select(*keys, F.struct(*insert_cols, F.lit(1).alias("__p")).alias("__first"),
                                F.struct(*update_cols, F.lit(1).alias("__p")).alias("__last"))
    else:
        order = order_col if order_col is not None else F.struct(*cols, F.lit(1).alias("__p"))
        # structs keep NULL fields: the whole first / last row counts, not the first non-NULL value
        batch = incoming.groupBy(*keys).agg(
            F.min_by(F.struct(*insert_cols, F.lit(1).alias("__p")), order).alias("__first"),
            F.max_by(F.struct(*update_cols, F.lit(1).alias("__p")), order).alias("__last"))
    batch = batch.withColumn("__in", F.lit(True))
    old = base.withColumn("__old", F.lit(True))
    b, i = old.alias("b"), batch.alias("i")
    on = [F.col(f"b.{k}") == F.col(f"i.{k}") for k in keys]
    joined = b.join(i, on, "full_outer")
    is_old, is_in = F.col("b.__old").isNotNull(), F.col("i.__in").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            value = F.coalesce(F.col(f"b.{c}"), F.col(f"i.{c}"))
        elif c == ts_col:
            value = F.when(is_in, stamp).otherwise(F.col(f"b.{c}"))
        elif c in update_cols:
            value = F.when(is_in, F.col("i.__last")[c]).otherwise(F.col(f"b.{c}"))
        else:
            value = F.when(is_old, F.col(f"b.{c}")).otherwise(F.col("i.__first")[c])
        return value.alias(c)

    return joined.select(*[pick(c) for c in base.columns])
