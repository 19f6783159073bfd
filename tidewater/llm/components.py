"""Connected components by alternating large and small stars, on edge tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import storage


#: Edges that a task writes at least, where there are as many.
_EDGES_PER_TASK = 100_000


def _star(edges: DataFrame, large: bool, tasks: int, name: str) -> DataFrame:
    """``edges`` (u, v) with u > v. Large: every node links its larger neighbours to its smallest
    neighbour or itself. Small: every node links itself and its smaller neighbours to the smallest.

    No edge is turned round: larger neighbours never lower a node's smallest, so the smallest of those that
    it is u to do, and a node that is u to none is its own. The smallest neighbours are written first: the
    join with them then has nothing but the exchanges of its two sides below it, so that a node with very
    many neighbours can be split over tasks."""
    least = storage.materialize(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), f"{name}-least")
    if large:
        of = least.withColumnRenamed("u", "node")
        moved = edges.join(of, edges.v == of.node, "left").select("u", F.coalesce("m", "v").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return storage.materialize(moved.filter("u > v").distinct().coalesce(tasks), name)


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that has none."""
    seen = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u")).first()
    centres = edges.select(F.col("v").alias("u")).distinct()
    return seen.n == seen.u and not edges.join(centres, "u", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges``; loops and nulls are ignored.

    Rounds grow with the logarithm of the longest path; each one is written to the shared folder."""
    a, b = F.col(left), F.col(right)
    current = storage.materialize(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    # a round adds no edges, so few edges stay few, and few tasks do for them
    tasks = 1 + current.count() // _EDGES_PER_TASK
    while not _are_stars(current):
        current = _star(_star(current, True, tasks, name), False, tasks, name)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
