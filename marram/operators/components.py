"""Connected components of a two-sided graph, by alternating stars as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.sources.shared import written


def _hang(edges: DataFrame) -> DataFrame:
    """Every node's neighbours of higher number are hung on its least neighbour or itself, then every node's lower ones."""
    for upward in (True, False):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else edges
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        joined = both.join(least, "a")
        if upward:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.select("a", F.col("low").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("low").alias("b")))
        edges = written(moved.filter("a > b").distinct(), "component-edges")
    return edges


def component_of(links: DataFrame, node: str, via: str) -> DataFrame:
    """(node, component): nodes that share a ``via`` with each other, directly or by others, are one.

    Rounds grow with the logarithm of the longest path.  Null nodes and vias link nothing.  The
    edge from each node to the least of its ``via`` is enough, so a hot ``via`` costs a row a node.
    """
    full = links.filter(F.col(node).isNotNull() & F.col(via).isNotNull()).select(F.col(node).alias("n"), F.col(via).alias("v")).distinct()
    low = full.groupBy("v").agg(F.min("n").alias("low"))
    edges = written(full.join(low, "v").filter("n > low").select(F.col("n").alias("a"), F.col("low").alias("b")).distinct(), "component-edges")
    before = None
    while True:
        edges = _hang(edges)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    every = full.select("n").distinct()
    return every.join(edges, every["n"] == edges["a"], "left").select(F.col("n").alias(node), F.coalesce("b", "n").alias("component"))
