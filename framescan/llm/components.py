"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's lower neighbours, and the node, move to the least of them. All edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a``, ``b``; longs).

    ``component`` is the least node reachable; nodes without edges are not
    listed.  Rounds of large-star and small-star (group minima with map-side
    combine, and joins that split hot nodes) until no edge moves; each round's
    edges are cut into the shared checkpoint folder.  The number of rounds
    grows with the logarithm of the number of nodes; the driver sees a count
    and a checksum a round.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    )
    state = _state(e)
    while state[0]:
        e = materialise(_small_star(_large_star(e)))
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
