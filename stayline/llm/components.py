"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import store


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """Ties each node's neighbours to the least of them and it: the greater neighbours, or itself and the smaller ones."""
    near = edges.select("a", "b") if smaller else edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("_node"), F.least("_least", "a").alias("_least"))
    met = near.join(least, F.col("a") == F.col("_node"))
    if smaller:  # b < a: the smaller neighbours and the node itself go to the least neighbour
        tied = met.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionAll(least.select(F.col("_node"), "_least"))
    else:
        tied = met.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return tied.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (a, b), root being the least node of the component.

    Loops, repeated and turned edges change nothing; edges with a null end are left out. Each round
    is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    now = store(now, "edges")
    seen = None
    while True:
        now = store(_star(_star(now, False), True), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
