"""Connected components of an edge table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, written


def components(edges: DataFrame, most_rounds: int = 50, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component) for each node of edges (a, b); a component's id is its least node.

    An edge to itself and repeated edges are of no consequence. Each round is written to the shared folder; the
    rounds end when the edges no longer change, after about the logarithm of the longest path. Least neighbours are
    broadcast while there are at most broadcast_rows edges (two ids each), else joined by a shuffle.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, size = None, now.count()
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        small = 2 * size <= broadcast_rows
        large = both.join(F.broadcast(least) if small else least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, "large") if small else large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(least) if small else least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        now = written(small, "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark, size = tuple(row), row[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
