"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace


def _large_star(work: Workspace, edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = work.save(low.select("a", F.least("a", "m").alias("m")), "low")
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(work: Workspace, edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them. Edges have ``a > b``."""
    low = work.save(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
    handed = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of each node with an edge; ``edges`` has the long columns ``a`` and ``b``.

    ``component`` is the smallest node that can be reached. Loops and null ends are ignored, repeated and
    reversed edges count once, and an empty table gives an empty result. Minima are combined before the shuffle and
    written, so that a hub only meets in a join of two shuffled tables, which Spark can split. The number of rounds
    grows with the logarithm of the longest path.
    """
    now = work.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    stamp = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(seen) == stamp or not seen[0]:
            break
        stamp = tuple(seen)
        large = work.save(_large_star(work, now), "edges")
        work.drop(now)
        now = work.save(_small_star(work, large), "edges")
        work.drop(large)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
