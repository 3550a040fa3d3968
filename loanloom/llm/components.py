"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import forget, kept


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    In each round every node passes its larger, then its smaller neighbours on to the smallest
    node it knows. Links never become more, and the rounds grow with the logarithm of a component's
    size. Each round is written to the shared folder, and the driver sees a count and a sum only.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")).select("_a", F.least("_a", "m").alias("m"))
        large = (both.join(least, F.col("a") == F.col("_a")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
        # a node's smaller neighbours and the node itself go to the smallest of them
        small = large.join(down, F.col("a") == F.col("_a")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        following = kept(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        now = _state(following)
        forget(edges)
        edges = following
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum over them; both stand still when the stars are done."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
