"""Connected components over an edge table, by alternating large and small stars.

Each round is two aggregations with partial minima before the shuffle and two joins back to the edges; the number of
rounds grows with the logarithm of the longest path. A node with many neighbours is split by adaptive skew joins, as
its minimum is one row. Edges stay in the cluster; the driver sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.rows import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that can be reached."""
    current = staged(_distinct(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    state = _state(current)
    while True:
        current = staged(_small_star(_large_star(current)))
        previous, state = state, _state(current)
        if state == previous:
            break
    # Stars: every node points to the least of its component.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    mix = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(mix.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(mix)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the least of it and all its neighbours."""
    # As v < u, only the larger end of an edge is a larger neighbour: of v.
    least = (edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("v").alias("m")))
             .groupBy("n").agg(F.min("m").alias("m")))
    return edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the least of them."""
    edges = edges.distinct()
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    linked = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(linked.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))))
