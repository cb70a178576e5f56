"""Connected components of a distributed edge list.

Alternating star contraction: a *large star* hangs every larger neighbour of a
node on the node's smallest neighbour, a *small star* does so with the smaller
ones.  Edges never outnumber the input's, no adjacency list is gathered (the
minimum per node is a map-side combined aggregate, joined back to the edges,
where adaptive execution splits a hot node), and the number of rounds grows
with the logarithm of the longest path.  Each round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import shared


def _hang(edges: DataFrame, smaller: bool) -> DataFrame:
    """One star step over (a, b); returns distinct edges (a > b)."""
    if smaller:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = near.join(least, "a")
    if smaller:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    else:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    The smallest node of a component itself is not listed.  No edges give no rows.
    """
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = shared(edges.select("a", "b").filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        edges = shared(_hang(_hang(edges, smaller=False), smaller=True))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
