"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
    return (
        both.filter("b > a").join(lowest, F.col("a") == F.col("n"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    linked = down.join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(lowest.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Every step keeps at most as many edges as it got plus one per node, and the number of rounds grows
    with the logarithm of the longest chain. Loops and repeated edges are harmless; nulls are dropped; no
    edges give no rows.
    """
    current = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        current = materialise(_small_star(_large_star(current)), "edges")
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)
