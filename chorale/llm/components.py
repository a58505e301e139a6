"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, combined map-side, and then the label's own label, so the
    number of rounds grows with the logarithm of a component's length. A node with very many neighbours is only a key
    with many rows on one side of a join whose other side is unique: adaptive execution splits it. Loops, repeated edges
    and edges in both directions change nothing; edges with a null end are left out; no edges give an empty table.
    """
    two = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = scratch.cut(two.union(two.select("b", "a")).distinct())
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = scratch.cut(labels.join(near, "node").select("node", F.least("root", "near").alias("next"), F.col("root").alias("was")))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("root"))
        after = scratch.cut(step.join(jump, "next").select("node", "root", (F.col("root") != F.col("was")).alias("moved")))
        scratch.drop(step)
        scratch.drop(labels)
        labels = after
        if after.where("moved").isEmpty():
            scratch.drop(both)
            return after.select("node", "root")
