"""Connected components of an edge table, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.session import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum: equal marks mean that a step changed nothing."""
    count, total = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return count, int(total or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    smallest = both.groupBy("node").agg(F.min("other").alias("least"))
    # a hub's neighbours may be a third of all edges; adaptive execution splits such a partition of this join
    return (
        both.filter("other > node")
        .join(smallest, "node")
        .select(F.col("other").alias("high"), F.least("least", "node").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    smallest = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(smallest, "high").filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return smallest.select("high", F.col("least").alias("low")).unionByName(moved).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable. Loops and repeats do no harm."""
    at = written(
        edges.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
        .distinct(),
        "component-edges",
    )
    mark = _mark(at)
    while mark[0]:
        at = written(_small_star(_large_star(at)), "component-edges")
        before, mark = mark, _mark(at)
        if mark == before:
            break
    roots = at.select(F.col("low").alias("node")).distinct()
    return at.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
