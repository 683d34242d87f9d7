"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum per vertex joined back to the edges, so a
hub is summed on the map side and its join partition can be split by AQE; no
vertex's neighbour list is ever gathered in one task.

No step makes more edges than there were at first, so their count tells how many tasks are
enough. With as many as the session has shuffle partitions, every step of a round would write
files for each of them, however few its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .durable import cut, gathered


def _least_neighbour(edges: DataFrame, tasks: int) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """edges: u > v. Every larger neighbour of a vertex is tied to the least vertex of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    least = _least_neighbour(both, tasks).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """edges: u > v. The smaller neighbours of a vertex and the vertex itself are tied to the least of them."""
    least = _least_neighbour(edges, tasks)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of an undirected edge list; component is the least vertex id reachable.

    Null ends and self loops add no edge; a vertex that only appears in such rows is not returned
    (callers left-join and default to the vertex itself). Repeated edges are harmless; an empty
    list gives an empty result.
    """
    current = gathered(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    tasks, mark = current.rdd.getNumPartitions(), None
    for _ in range(max_rounds):
        current = cut(_small_star(_large_star(current, tasks), tasks)).coalesce(tasks)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
