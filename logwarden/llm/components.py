"""Connected components of an undirected graph by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


OWN_ORDER = 2  # passes by the nodes' own order


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Each pass maps every node to the first of itself and its neighbours and renames the edges; edges within a name
    vanish. The first two passes go by the nodes' own order, which ends stars; later ones draw a new order by a hash, which
    takes an expected share of the names away in every pass, whatever the graph. Each pass is written out.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = stored(tidy(edges), "edges")
    nodes, passes = None, 0
    while nodes is None or not edges.isEmpty():
        drawn = passes >= OWN_ORDER
        rank = F.xxhash64("b", F.lit(passes)) if drawn else F.col("b")
        own = F.xxhash64("node", F.lit(passes)) if drawn else F.col("node")
        passes += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("root"))).alias("first"))
        first = F.least("first", F.struct(own.alias("rank"), F.col("node").alias("root")))
        named = stored(near.select("node", first.root.alias("root")), "names")
        if nodes is None:
            nodes = named
        else:
            step = named.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nodes = nodes.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        first = named.select(F.col("node").alias("a"), F.col("root").alias("x"))
        second = named.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stored(tidy(edges.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    nodes = stored(nodes, "components")
    if passes <= OWN_ORDER:
        return nodes
    least = nodes.groupBy("root").agg(F.min("node").alias("least"))
    return stored(nodes.join(least, "root").select("node", F.col("least").alias("root")), "components")
