"""Connected components of a table of edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node long, component long`: for each node of an edge, the least node that it is connected with.

    First each node's edges to smaller nodes become one to the least of them, and one from each of the others to it: many
    nodes that share many neighbours are left with about an edge each.

    Each round takes the least label of the neighbours, then the label of that label, and is checkpointed; chains of n
    nodes take about log n rounds. Nothing but one number a round comes to the driver. A node with very many edges is a
    skewed join key, which adaptive execution splits. No edges give an empty table."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct()
    pairs = durable(pairs, "pairs")
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    hooked = durable(pairs.join(least, "a"), "hooked")
    pairs = hooked.select("a", F.col("least").alias("b")).unionByName(hooked.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()
    both = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")

    def total(table: DataFrame):
        return table.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]

    before = total(labels)
    while before is not None:
        near = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("label").alias("near"))
        nearest = labels.join(near, labels.node == near.b).select("node", F.least("label", "near").alias("label"))
        nearest = durable(nearest, "nearest")
        target = nearest.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = durable(nearest.join(target, nearest.label == target["at"]).select("node", F.least("label", "further").alias("label")), "labels")
        after = total(labels)
        if after == before:
            break
        before = after
    return labels.select("node", F.col("label").alias("component"))
