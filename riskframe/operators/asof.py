"""As-of join per entity: for every request the entity's last row at or before the request's own time.

Requests and history are merged into one order (key, time, history first) and cut into ranges of about equal
row count, so that a key with many rows spreads over many tasks.  Inside a range the last history row is
carried forward by a window; only keys that meet a range's end (two per range at most) need the last row of
the ranges before, which is a table of that size.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.operators.snapshot import resolve_refs
from riskframe.session import cut_lineage


def asof_join(requests: DataFrame, history: DataFrame, key: str, at: str, ts: str, features: Sequence[str],
              tiebreak: Sequence[str] = (), ttl: timedelta | None = None, found_ts: str | None = None,
              n_ranges: int | None = None) -> DataFrame:
    """The requests' columns with ``features`` of the last history row with ``ts`` <= ``at``, NULL without one.

    Of history rows of one key and time the greatest ``tiebreak`` counts, then the greatest features.  With ``ttl`` a row
    older than the request's time less that is expired and gives NULLs.  ``found_ts`` names a column for the row's
    time.  Every request row comes out once, repeated ones too; a NULL key or time finds nothing; history without key or time is left
    out.  A feature named like a request column is refused.
    """
    clash = sorted(set(features) & set(requests.columns))
    if clash:
        raise ValueError(f"requests already have {clash}")
    n = n_ranges or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(requests.dtypes)[key]
    row = F.struct(F.col(ts).cast("timestamp").alias("__ts"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(features)])
    # ties are told apart by what is sorted last, so ranges and windows see one order
    order = F.struct(F.lit(0).alias("late"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)], row.alias("row"))
    old = history.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast(kind).alias("__key"), F.col(ts).cast("timestamp").alias("__at"), F.lit(False).alias("__asks"),
        order.alias("__row"), F.lit(None).cast(requests.select(F.struct("*")).schema[0].dataType).alias("__request"))
    asked = requests.select(
        F.col(key).alias("__key"), F.col(at).cast("timestamp").alias("__at"), F.lit(True).alias("__asks"),
        F.lit(None).cast(old.schema["__row"].dataType).alias("__row"), F.struct("*").alias("__request"))
    # the ranges' bounds are sampled, so the dealt rows are written once before anything depends on them
    dealt = cut_lineage(old.unionByName(asked).repartitionByRange(n, "__key", "__at", "__asks").withColumn(
        "__range", F.spark_partition_id()))

    ordered = Window.partitionBy("__range", "__key").orderBy("__at", "__asks", "__row")
    carried = F.last("__row", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt.withColumn("__found", carried).where("__asks")

    # keys at the ends of a range, and what each has last in it
    ends = dealt.groupBy("__range").agg(F.min("__key").alias("lo"), F.max("__key").alias("hi"))
    met = ends.select("__range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__key")).where("__key is not null")
    last = dealt.where("not __asks").join(F.broadcast(met), ["__range", "__key"]).groupBy("__range", "__key").agg(
        F.max_by("__row", F.struct("__at", "__row")).alias("__last"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    brought = met.join(last, ["__range", "__key"], "left").select(
        "__range", "__key", F.last("__last", ignorenulls=True).over(before).alias("__brought")).where("__brought is not null")
    joined = inside.join(F.broadcast(brought), ["__range", "__key"], "left")

    found = F.coalesce("__found", "__brought")["row"]
    alive = F.col("__at").isNotNull() & F.col("__key").isNotNull()
    if ttl is not None:
        alive &= found["__ts"] >= F.col("__at") - F.lit(ttl)
    names = [(f"f{i}", c) for i, c in enumerate(features)] + ([("__ts", found_ts)] if found_ts else [])
    return joined.select("__request.*", *[F.when(alive, found[f]).alias(c) for f, c in names])


def get_features_at(requests: DataFrame, history: DataFrame, key: str, at: str, ts: str, refs: Sequence[str] | None = None,
                    ttl_days: int = S.FEATURE_TTL_DAYS, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Referenced features as of each request's own time; the TTL counts back from that time."""
    cols = resolve_refs(refs)
    absent = [c for c in cols if c not in history.columns]
    if refs is not None and absent:
        raise ValueError(f"the history lacks {absent}")
    return asof_join(requests, history, key, at, ts, [c for c in cols if c not in absent], tiebreak, timedelta(days=ttl_days))
