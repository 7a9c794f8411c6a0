"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour.

    The large star moves the larger neighbours, the small star the node itself
    and its smaller ones. Minima are aggregated before the shuffle. The rows of
    a node with very many neighbours meet its minimum in a join, which the
    adaptive skew split serves: the other side has one row per node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b <= a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other node or has nodes hanging on it, not both."""
    ends = edges.select(F.col("a").alias("node"), "b").unionByName(
        edges.select(F.col("b").alias("node"), F.lit(None).alias("b"))
    )
    roles = ends.groupBy("node").agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.bool_or(F.col("b").isNull()).alias("root")
    )
    return roles.where("lo != hi OR (root AND lo IS NOT NULL)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link to another; comp is the least node.

    ``links`` has columns a and b in any order, repeated or not. The number of
    rounds grows with the logarithm of the longest chain. Each round is cut off
    by a written table; one truth value per round reaches the driver.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not _is_forest_of_stars(edges):
        before, edges = edges, written(_stars(_stars(edges, large=True), large=False), "edges")
        discard(before)
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return hung.unionByName(roots)
