"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long, not null); root is the smallest node reachable.

    Each round ties every node's larger neighbours to its smallest one, then its smaller ones, so
    that trees grow flat, in about as many rounds as the logarithm of the longest path. Links are aggregated by
    node and never paired; every round is staged, so a lost task repeats one round.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        # Large star: neighbours above a node meet its smallest neighbour, or the node itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stage(_tied(both, larger_only=True), "large-star")
        # Small star: a node and those below it meet the smallest of them.
        edges = stage(_tied(edges, larger_only=False), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select("b", "b").distinct().toDF("node", "root"))
        seen = state


def _tied(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Edges (a, b) as (larger, smaller) after one star operation around each ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.withColumn("m", F.least("a", "m")), "a")
    if larger_only:
        tied = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()
