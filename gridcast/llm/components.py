"""Connected components of an edge table, as Spark jobs only.

Alternating star contraction: each round links every neighbour of a node to
the smallest node of its neighbourhood, first the larger neighbours, then the
smaller ones. Rounds grow with the logarithm of the component size, not with
its diameter. No edge list, label or component ever reaches the driver; only
one (count, checksum) row a round does. Each round's edges are written to the
shared folder, so a lost executor never replays the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_ROUNDS = 200


def _star(directed: DataFrame, keep_larger: bool) -> DataFrame:
    """``directed``: (u, v), v a neighbour of u. Link the chosen side of u's neighbourhood to its minimum."""
    low = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = directed.join(low, "u")
    if keep_larger:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = low.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    return linked.where((F.col("v") < F.col("u")) & (F.col("v") != F.col("m"))).select(
        F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Edges are undirected; self-loops, repeated edges and nulls are ignored.
    Nodes without an edge do not appear: a caller's left join keeps them as
    their own component.
    """
    x, y = F.col(a), F.col(b)
    e = staged(edges.where(x.isNotNull() & y.isNotNull() & (x != y))
               .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        e = staged(_star(down, False).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
