"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies (target / source size).  The
expected copies are summed along the source, one random offset per source is added, and a document is
emitted once per integer boundary its stretch crosses.  Documents are laid out by size, so that the
copies of equally long documents alternate and the words taken stay within about one document of the
target.

The running position of a document never needs a source in one task: rows are counted per
(source, size class, spread), those few counts are summed along the source, and only the position
inside a group comes from a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.text import word_count
from riskframe.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
ROWS_PER_GROUP = 500_000


def size_class(size: Column) -> Column:
    """The size with all but its five leading bits cleared: at most 16 classes per doubling."""
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source, and what is over is shared again by weight.
    That ends where every target is min(cap, level x weight); the level is found from the sources
    sorted by cap per unit of weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    caps = per.withColumn("weight", F.get(turn, place % len(weights))).withColumn(
        "cap", F.col("source_size") * F.lit(float(most)))
    # one row per source from here on
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = caps.withColumn("over", (F.sum("source_size").over(everything) * F.lit(float(share))
                                     - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
                            / F.sum("weight").over(rest))
    # the level is the first one that its own source does not cap; the ones after it are lower
    level = level.withColumn("level", F.max(F.when(F.col("over") * F.col("weight") <= F.col("cap"), F.col("over")))
                             .over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return level.select("source", "source_size", target.alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\\0"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def plan_mix(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
             seed: int = 7, spread: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for (doc_id, source, size) rows.

    ``spread`` splits a size class so that a group stays near ``ROWS_PER_GROUP`` rows; it only
    changes the order of equally long documents.
    """
    sizes = cut_lineage(sizes)
    if spread is None:
        spread = max(1, -(-sizes.count() // ROWS_PER_GROUP))
    targets = source_targets(sizes, weights, share, most)
    # rows that repeat an id follow each other in any order: they are alike
    keyed = sizes.withColumns({"__class": size_class(F.col("size")),
                               "__spread": F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(spread))})
    group = ["source", "__class", "__spread"]
    before = (Window.partitionBy("source").orderBy("__class", "__spread")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).select(
        F.col("source").alias("__source"), F.col("__class").alias("__c"), F.col("__spread").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = keyed.withColumn("__place", F.row_number().over(
        Window.partitionBy(*group).orderBy("size", F.col("doc_id").asc_nulls_first())))
    placed = inside.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__class") == F.col("__c"))
                         & (F.col("__spread") == F.col("__s")))
    goals = targets.select(F.col("source").alias("__goal_source"), "source_size", "target",
                           F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                           .otherwise(0.0).alias("__rate"))
    placed = placed.join(goals, F.col("source").eqNullSafe(F.col("__goal_source")))
    position, offset = F.col("__before") + F.col("__place"), random_offset(F.col("source"), seed)
    crossed = F.floor(position * F.col("__rate") + offset) - F.floor((position - 1) * F.col("__rate") + offset)
    # a stretch of length r crosses at most ceil(r) boundaries; rounding must not add one
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         F.least(crossed, F.ceil("__rate")).cast("long").alias("copies"))


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count("text").alias("size"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    NULL texts have size 0; a source without words has target 0; NULL is a source of its own; an
    empty table gives an empty result.  Repeated rows are mixed one by one.  The same input gives the
    same result in every run.
    """
    return plan_mix(document_sizes(docs), **settings).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents with their own columns, each as often as its copies.

    Rows that repeat id, source and size are alike to the plan; they are numbered on both sides, so
    each takes the copies of one of them.
    """
    def keyed(df: DataFrame, doc_id: Column, source: Column, size: Column, order: Column) -> DataFrame:
        # plain equal keys (NULLs told apart by flags): one partitioning serves window and join
        df = df.withColumns({"__id": F.coalesce(doc_id, F.lit(0)), "__no_id": doc_id.isNull(), "__size": size,
                             "__source": F.coalesce(source, F.lit("")), "__no_source": source.isNull()})
        return df.withColumn("__rep", F.row_number().over(
            Window.partitionBy("__id", "__no_id", "__source", "__no_source", "__size").orderBy(order)))

    keys = ["__id", "__no_id", "__source", "__no_source", "__size", "__rep"]
    plan = keyed(plan_mix(document_sizes(docs), **settings), F.col("doc_id"), F.col("source"), F.col("size"),
                 F.col("copies").desc()).where("copies > 0").select(*keys, F.col("copies").alias("__copies"))
    rows = keyed(docs, F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text"),
                 F.xxhash64("text"))
    return rows.join(plan, keys).select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
