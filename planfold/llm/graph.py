"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planfold.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the smallest id reachable, for each node that has one smaller than itself.

    Each step keeps at most as many edges as before and points nodes at smaller ones; it ends when every edge leads straight to a root:
    no node with an edge to a smaller one has another, or is itself led to. Nothing but that answer comes to the driver; each round is
    cut by a checkpoint."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if unsettled.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        e = cut(small)
