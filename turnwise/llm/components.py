"""Connected components of a graph given by its edges, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.written import written


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: one row, whatever the number of edges."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    far = both.where("b > a").join(least, "a")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge: ``node``, ``root`` (its least node).

    ``edges`` has two long columns ``a`` and ``b``; loops, repeats and nulls are ignored. Alternates the two
    star steps, each a pre-aggregated minimum and a join, until nothing changes: the number of rounds
    grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    forward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(forward.where("a > b").distinct(), "edges")
    before = _fingerprint(current)
    while True:
        current = written(_small_star(_large_star(current)), "edges")
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
