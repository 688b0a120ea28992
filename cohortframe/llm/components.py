"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import drop, materialize


def _settled(edges: DataFrame) -> bool:
    """Is every node either the end of one edge or a root, and no root the end of another edge?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.root").alias("root"))
    return seen.where("out > 1 or (out = 1 and root = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each round is two aggregations with map-side combine and two joins against
    one row per node, so no neighbour list is gathered anywhere, and a hub's edges may be split over tasks by
    adaptive execution.  Every round is a written table.  Rounds grow with the logarithm of the longest path, and end
    when every edge leads from a node of no other edge to its root.  :func:`drop` deletes the table behind the result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = materialize(now, "edges")
    while not _settled(now):
        # large star: larger neighbours of a move to its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        drop(now)
        now = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    out._cohortframe_path = now._cohortframe_path  # for drop()
    return out
