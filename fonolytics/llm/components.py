"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.store import written


def _lowest(arcs: DataFrame) -> DataFrame:
    """Per node u of the arcs (u, v): the smallest of u and its neighbours. Summed up per task first, so a hub is no hot key."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    moved = down.join(_lowest(down), "u")
    pairs = moved.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(moved.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return pairs.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Each step is written to the shared folder. It ends when every link leads
    from a leaf to a root of its own, after about the logarithm of the longest
    path. No links: an empty result.
    """
    edges = links.where("a <> b").select("a", "b")
    while True:
        edges = written(_small_star(_large_star(edges)).select("a", "b"), "stars")
        # a node seen as a leaf twice, or both as a leaf and as a root, is not settled
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("leaf")))
        open_ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least")).where("leaf > 1 or (leaf > 0 and least = 0)")
        if open_ends.first() is None:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
