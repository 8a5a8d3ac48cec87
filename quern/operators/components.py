"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, label`` of every node of ``a, b`` edges; ``label`` is the least id of its component.

    Each round hangs neighbours on the least one they share (large star: those above the node; small star: those
    below), and the rounds end when nothing changes; their number grows with the logarithm of the longest path.
    Grouping keeps a minimum only, so a node with very many neighbours costs no memory.
    """
    now = settle(_canonical(edges), "stars")
    while True:
        large = _star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), above=True)
        small = settle(_star(large, above=False), "stars")
        # a forest of stars is reached when no node is both a centre and a leaf, and leaves have one centre
        centres = small.select(F.col("a").alias("b")).distinct()
        deeper = small.join(centres, "b", "left_semi").isEmpty()
        if deeper and small.groupBy("b").count().filter("count > 1").isEmpty():
            break
        now = small
    leaves = small.select(F.col("b").alias("id"), F.col("a").alias("label"))
    return leaves.unionByName(small.select(F.col("a").alias("id"), F.col("a").alias("label"))).distinct()


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges with ``a < b``."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """``above``: for a node ``a`` hang neighbours ``b > a`` on the least of ``a`` and all its neighbours; else, with ``b`` the node and
    ``a`` its smaller neighbours, hang the node and them on the least."""
    if above:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return _canonical(edges.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return _canonical(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")))
