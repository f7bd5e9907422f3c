"""Connected components of links between long ids, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step on edges (u, v) in both directions: link each node's larger (else: smaller or equal)
    neighbours to the least of its neighbours and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("w"))
    if larger:
        return joined.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    moved = joined.where("v < u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.where("m < w").select(F.col("w").alias("x"), F.col("m").alias("y")))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (columns a, b): label is the least node reachable.

    Large-star and small-star steps alternate until no edge changes, a number of rounds that grows with the
    logarithm of the nodes. Each round is written to the shared folder. A node's links are aggregated before
    the shuffle; a join with a node of many links is one that Spark can split.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    sign = _sign(edges)
    while sign[0]:
        grown = _star(_both(edges), True).where("x <> y").distinct()
        before = edges
        edges = materialise(_star(_both(grown.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))), False).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
        release(links.sparkSession, before)
        if (new := _sign(edges)) == sign:
            break
        sign = new
    # now every edge leads from a node to its component's least
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
