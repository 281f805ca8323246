"""Connected components of an edge table by alternating star steps.

Every round replaces edges by smaller ones: the large-star step links the
larger neighbours of a node to its smallest neighbour, the small-star step
links the smaller neighbours and the node itself to that minimum.  The graph
becomes stars around the smallest node of each component after a number of
rounds that grows with the logarithm of the node count.  Rounds run until the
edges no longer change; each is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import cut

MAX_ROUNDS = 200  # far beyond the logarithm of any table; reaching it is an error


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node reachable from each node.

    Nodes without edges are not in the result; loops only name their node.
    """
    nodes = edges.select(F.col("a").alias("node"))
    loops = nodes.unionAll(edges.select(F.col("b").alias("node"))).distinct()
    cur = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = cur.transform(cut)
    before = _state(cur)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # large star: every larger neighbour of a node gets the node's minimum
        sym = _both_ways(cur)
        least = sym.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        # small star: edges now run from larger to smaller nodes
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        cur = small.transform(cut)
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (loops.join(cur.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
