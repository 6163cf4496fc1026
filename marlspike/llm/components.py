"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import checkpoint, forget, settled


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself.

    edges: (a, b) with a < b. Large star: the greater neighbours; small star: the smaller ones and
    the node itself. Minima are combined before the shuffle, so no node's links meet in one task
    but in a join, which Spark can split."""
    if small:
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        out = edges.join(settled(low, "b"), "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = settled(low, "u")
        # greater neighbours of u: the edges (a, b) with a = u
        out = edges.join(low, edges["a"] == low["u"]).select(F.col("m").alias("a"), F.col("b"))
    return out.where("a < b").distinct()


def _loose(edges: DataFrame) -> bool:
    """Whether the edges are anything else than stars of greater nodes around a smallest one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return bool(ends.groupBy("e.node").agg((F.max("e.up") + F.sum("e.down")).alias("n")).where("n > 1").limit(1).count())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b) with a < b; component is its smallest node.

    Each round is written to the shared folder and the one before deleted. Rounds grow with the
    logarithm of the longest chain; the edges end as stars around each component's smallest node."""
    edges = checkpoint(links.select("a", "b").distinct())
    for _ in range(most_rounds):
        if not _loose(edges):
            break
        before, edges = edges, checkpoint(_star(_star(edges, small=False), small=True))
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
