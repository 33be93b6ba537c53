"""Connected components by alternating stars, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import cut, discard


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b); the component is its smallest node.

    Each round moves the larger neighbours of a node and then its smaller ones
    to the smallest node around; stars remain after a number of rounds that
    grows with the logarithm of the longest path. A round totals neighbours with
    combining aggregates and joins the minimum back, so that a node with very
    many links is spread like any skewed join key. Every round is written to the
    shared folder. Self links and repeated links change nothing; an empty table
    gives an empty table.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
    )
    while not _stars(edges):
        after = cut(_small_star(_large_star(edges)).distinct())
        discard(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def merged_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: `known` is a result of these functions, links (a, b) may name new nodes.

    Links are drawn between the components they touch, so the work is that of
    the links that are new, not of all so far.
    """
    ends = links.select("a", "b")
    for side in ("a", "b"):
        home = known.select(F.col("node").alias(side), F.col("component").alias("home"))
        ends = ends.join(home, side, "left").withColumn(side, F.coalesce("home", side)).drop("home")
    moves = connected_components(ends)
    moved = known.join(moves.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(moved.union(moves.join(known, "node", "left_anti").select("node", "component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that itself hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("v", F.lit(0), F.lit(1)),
    )
    unsettled = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs > 0 and holds > 0)")
    return unsettled.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v"), F.col("least"))
    return moved.union(least).toDF("u", "v")
