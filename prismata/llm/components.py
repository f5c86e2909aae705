"""Connected components of an edge table, by alternating star contraction.

Each round replaces a node's edges by edges to the smallest neighbour, first
towards larger neighbours and then towards smaller ones.  Rows never outnumber
the edges, a round is two shuffles with partial aggregation, and rounds grow
with the logarithm of the longest chain.  Rounds are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; edges are (u, v) with u > v."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = common.settled(least)  # as a table of its own, so that the join can split a node with many edges
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has an edge, and its component's smallest node."""
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    state, before = common.settled(pair), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        state = common.settled(_star(_star(state, True), False))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
