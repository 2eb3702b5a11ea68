"""Connected components of a large edge table, by alternating star contraction.

Every round replaces edges by edges to smaller nodes until each component is a star
around its smallest node (Kiveris et al., "Connected components in MapReduce and
beyond").  Each step is a map-side combined minimum and an equi-join, so a node with
very many neighbours is no hot task: the minimum is combined before the shuffle and the
join may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b.

    Large: every neighbour above the node goes to the node's smallest neighbour.
    Small: every neighbour below the node, and the node itself, goes to the smallest.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        out = out.select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b) but each component's smallest.

    Nodes are longs; null ends and loops are dropped; ``component`` is the smallest node
    reachable.  A node that is missing from the result is its own component.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_ok")).where("_ok and a > b").select("a", "b").distinct()
    edges, before = work.save(edges, f"{name}-0"), None
    for k in range(1, most_rounds + 1):
        step = work.save(_star(_star(edges, True), False), f"{name}-{k}")
        sums = step.agg(F.count("*"), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        edges = step
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
