"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); a component's name is its smallest
    node. Loops, repeated edges and edges with a null are ignored.

    Large and small stars in turn: every node hands its smallest neighbour to the others, until
    all edges lead to the smallest node of a component. Each round is written and read
    again, so a lost executor costs one round; there is no task per component.
    """
    linked = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(edges.where("a != b").select(*linked).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(smallest, "a").select(ends, F.col("m").alias("b")).where("a != b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
