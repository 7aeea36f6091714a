"""Connected components of a link table as joins and aggregates over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.workspace import Workspace


def connected_components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """Union-find by alternating large-star and small-star steps.

    links(a, b) are undirected. Returns (node, component) for every node with a link to
    another one; component is the smallest node reachable. Both steps only aggregate
    minima (combined before the shuffle) and join each edge to its node's minimum, so a
    node with very many neighbours is never gathered in one row. The number of rounds
    grows with the logarithm of the longest shortest path. Self links, repeated links and
    an empty table are allowed.
    """
    edges = ws.table(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}_0",
    )
    turn, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each neighbour above a node hangs on the node's minimum.
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = ws.table(large, f"{name}_large_{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: each neighbour below a node, and the node, hang on its minimum.
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        turn += 1
        edges = ws.table(small, f"{name}_{turn}")
        ws.drop(f"{name}_{turn - 1}", f"{name}_large_{turn - 1}")
        sums = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        state = (sums["n"], sums["h"])
        if state == before or not sums["n"]:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
