"""Connected components of links between nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the smallest node reachable.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest
    neighbour (large star, small star). Minima are added up before the shuffle, so a node with
    very many links costs one row per task. Rounds grow with the logarithm of the longest chain.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = settled(links.filter("a > b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("l")).select("l.*")
        links = settled(small.filter("a > b").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
