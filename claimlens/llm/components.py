"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that it reaches.

    Links are undirected longs without nulls; loops and repeats do no harm; no links give no rows. A round hangs all
    neighbours of a node onto the smallest of them, first the larger ones, then the smaller ones; the table never
    grows by more than a constant and is written after each round. Minima of a node's neighbours are combined before
    the shuffle, so a node with very many links costs one row per task there; the join beside it is one that Spark
    splits on skew. Ends when a round changes nothing.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = stage(links.where("a <> b").select(larger, smaller).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stage(small.union(low).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())
