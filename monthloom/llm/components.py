"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.workspace import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node that has a link.

    Rounds of two steps, each one aggregation per node: every node hands its larger neighbours the smallest node it
    knows, then its smaller neighbours. Long chains shrink by halves. A hot node's links are split over tasks, since the
    smallest neighbour is found by partial aggregates. Each round is written, and rounds end when nothing changes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        new = written(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        # Sums of hashes tell whether the set of edges is another.
        if _print(new) == _print(edges):
            break
        edges = new
    inner = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.union(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _print(edges: DataFrame) -> tuple:
    mix = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mix % 1_000_000_007), F.bit_xor(mix)).first())
