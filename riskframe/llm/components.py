"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each component; nodes are those of the edges.

    Each round takes the least label among a node's neighbours and then the label of its label, so
    long chains halve; rounds are written to the shared folder and end when no label changes.  Labels
    are aggregated before they are shuffled, so a node with very many links is one partial row per
    task, and the joins are on keys Spark can split.
    """
    both = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(
        edges.select(F.col(b).alias("u"), F.col(a).alias("v"))))
    labels = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = cut_lineage(hooked.join(above, "label").select("node", "old", F.least("label", "higher").alias("label")))
        changed = step.where("old != label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
