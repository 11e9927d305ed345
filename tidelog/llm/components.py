"""Connected components of links, by alternating large-star and small-star steps as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scope: Scope | None = None) -> DataFrame:
    """``(node, component)`` of all nodes of ``links(a, b)``; the component is its smallest node.

    Each round hangs larger neighbours on the smallest, first for all neighbours and then for smaller ones; it ends when nothing changes, after
    a number of rounds that grows with the logarithm of the longest path. Loops and repeated links do no harm. No links give no rows.

    A node may have very many neighbours. Their least is stored before the neighbours meet it, so that the join reads two plain shuffles, of which Spark
    splits the partition of such a node.
    """
    scope = Scope.of(scope, links)
    edges = scope.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    last, now = None, _signature(edges)
    while last != now:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scope.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = scope.stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = scope.stored(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        new = scope.stored(small.distinct(), "edges")
        scope.drop(edges, least, large, lower)
        edges, last, now = new, now, _signature(new)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
