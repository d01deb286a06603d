"""Connected components of an edge table by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (long columns a, b).

    Large star: every node sends its larger neighbours to its smallest one. Small star: every node sends its smaller
    neighbours and itself to the smallest of them. Each keeps components and shortens paths; after a number of rounds that
    grows with the logarithm of the longest path, only stars are left. A node's smallest neighbour is an aggregate that is
    joined back, so a node of very many neighbours is not one task's work.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = stored(small, "edges")
        # stars: no node has two edges down, and none has an edge down and one from above
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots with further edges: the components' roots are joined, of which there are fewer than nodes."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).where("a <> b")
    above = components(ends).withColumnRenamed("root", "top")
    moved = roots.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.union(above.select("node", F.col("top").alias("root"))).distinct(), "roots")
