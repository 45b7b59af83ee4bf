"""Connected components of a graph given as pairs of node ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.session import written


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has long columns ``a`` and ``b``. Each round links the larger neighbours
    of a node to its smallest one (large star), then all smaller ones to the smallest
    (small star), until every edge points at the smallest node of its component. A
    round is written to the shared folder, which cuts the lineage. The number of rounds
    grows with the logarithm of the longest path. A star of many nodes is aggregated by
    partial minima and joined back, never gathered in one place.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Edges now point from the larger to the smaller node.
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = written(small.filter("a <> b").distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
