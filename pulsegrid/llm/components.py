"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node of ``edges``; the label is the least node of its component.

    Each round takes the least label among a node's neighbours and jumps to
    that label's own label, so paths halve; sums are made before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        stepped = labels.join(seen.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = cut_lineage(stepped.join(jump, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")))
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels
