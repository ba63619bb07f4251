"""Connected components of an edge list, by alternating star contraction.

Each round links every node's larger neighbours, then its smaller ones, to the
least node around it (large star, small star).  Edges never grow in number and
paths shorten fast, so few rounds are needed; each step of a round is cut by a
table in the shared folder, so that no step is planned or run twice: what the
driver holds follows the exchanges it plans, not the edges.  No neighbourhood is
gathered: a node's edges are aggregated (min) and joined, and those of the few
nodes with very many edges are joined by broadcast, where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Nodes with more than this part of all edge ends are at most as many, so their table is broadcast.
HOT_SHARE = 1000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (orderable ids).  Gives node, root (least id of its component) of every node with an edge."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        around = _both(edges).groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("u")).alias("below"))
        nodes = materialise(around, "nodes")
        # stars, where all edges point from a node to a root: a node below another has one edge
        ends, most, tangled = nodes.agg(F.sum("n"), F.max("n"), F.count_if((F.col("below") > 0) & (F.col("n") > 1))).first()
        if not tangled:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("root"))
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        often = ends / HOT_SHARE
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = nodes.select("u", "m")
        if most > often:
            hubs = F.broadcast(nodes.filter(F.col("n") > often).select("u", "m"))
            large = up.join(hubs, "u").unionByName(up.join(hubs, "u", "left_anti").join(least, "u"))
        else:
            large = up.join(least, "u")
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small star: a node and its lower neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(both).alias("edge")).select("edge.u", "edge.v")
        edges = materialise(small.filter("u <> v").distinct(), "edges")
