"""Connected components by alternating stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b.

    The table of minima is written before it is joined, so a node with very many neighbours
    is split over tasks by an adaptive join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = materialise(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")), "graph-low")
    hung = both.join(low, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = hung.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
    done = materialise(out.filter("a > b").distinct(), "graph-edges")
    discard(low)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (a, b: long).

    ``root`` is the component's smallest node.  Rounds grow with the logarithm of the longest
    path; each writes its edges to the shared folder.  The answer is a written table.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-edges")
    state = None
    for _ in range(MAX_ROUNDS):
        wide = _star(now, True)
        discard(now)
        now = _star(wide, False)
        discard(wide)
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    done = materialise(out, "graph-roots")
    discard(now)
    return done
