"""Connected components of a graph that no driver and no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import dropped, written

#: Rounds before giving up; each round at least halves the paths, so 2 ** 40 nodes in a line would do.
MOST_ROUNDS = 60


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an edge reaches. Nodes without edges don't occur.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its smallest
    neighbour, then every node hangs its smaller neighbours (and itself) on it. Both are a minimum per node,
    combined on the map side, and a join that adaptive execution can split where a node has very many
    edges. The edges of each round are written to the shared folder; only their count and a checksum reach the driver.
    Self-loops, repeated edges and edges in both directions are allowed; null ends are ignored.
    """
    current = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = written(current, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: v > u keeps its link to the smallest neighbour of u instead of u.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: now every link goes down; all smaller neighbours of u hang on the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        past, current = current, written(hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(past)
        after = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
