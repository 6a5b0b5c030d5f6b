"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propweave.sources.scratch import materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of an edge; ``root`` is the smallest node it is connected to.

    ``edges`` has long columns a and b. Every step is a join with one row per node on one
    side, so a node with a third of all edges is split like any skewed join key.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    check = {"sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    before, after = {}, {}
    e = materialise(e, name, also=check, seen=before)
    while before["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # stored in between: a short plan is worked out and replanned at less cost than a deep one with its parts repeated
        large = materialise(both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), f"{name}-large")
        # an edge from a node to its own smallest neighbour stays by the other end's step
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))).distinct()
        e = materialise(small, name, also=check, seen=after)  # a is the larger node in every row
        if before == after:
            break
        before = dict(after)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
