"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.scale import write_through


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's smallest node.

    Each node points to the smallest of itself and its neighbours; pointers are then followed
    twice as far per step until they end at a node that points to itself, and edges are
    contracted to those ends. A chain ends in one contraction, whatever its length; every
    contraction at least halves the nodes that still have an edge.
    """
    left = write_through(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = write_through(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = write_through(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"))
        while True:
            farther = pointer.select(F.col("node").alias("to"), F.col("to").alias("_far"))
            jumped = write_through(pointer.join(farther, "to").select("node", F.col("_far").alias("to"), (F.col("_far") != F.col("to")).alias("_moved")))
            pointer = jumped.select("node", "to")
            if jumped.filter("_moved").isEmpty():
                break
        ends = pointer.select(F.col("node").alias("root"), "to")
        found = write_through(found.join(ends, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        at = [pointer.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"]
        moved = left.join(at[0], "a").join(at[1], "b").filter("_a <> _b")
        left = write_through(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return found
