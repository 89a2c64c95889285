"""Breadth-first walks and checks over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.windows import salted_join
from quillstack.session import checkpointed


def breadth_first(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None, max_nodes: int | None = None, valid: DataFrame | None = None
) -> DataFrame:
    """Nodes reachable from ``seeds`` (column node) over ``edges`` (src, dst) with their depth.

    One round per depth: the frontier selects edges, new nodes are those not seen before. Each round is checkpointed,
    so a lost executor costs one round. ``valid`` (column node) limits the nodes whose edges are followed. With
    ``max_nodes`` the first nodes by (depth, node) are returned. Runs jobs; ``max_depth`` None walks to the end.
    """
    links = edges.select("src", "dst").filter("src <> dst")
    visited = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        active = frontier.select(F.col("node").alias("src"))
        if valid is not None:
            active = active.join(valid.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        reached = salted_join(links, active, ["src"], how="left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = checkpointed(fresh)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if max_nodes is not None and visited.count() >= max_nodes:
            break
    return visited if max_nodes is None else visited.orderBy("depth", "node").limit(max_nodes)


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a graph (nodes: id, type): duplicate ids, not exactly one start, no end, unreachable nodes."""
    duplicates = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate id").alias("problem"), F.col("id").alias("node")
    )
    totals = nodes.select("id", "type").distinct().agg(
        F.count_if(F.col("type") == "start").alias("starts"), F.count_if(F.col("type") == "end").alias("ends")
    )
    starts = totals.filter("starts <> 1").select(
        F.lit("start count").alias("problem"), F.col("starts").cast("string").alias("node")
    )
    ends = totals.filter("ends = 0").select(F.lit("no end").alias("problem"), F.lit("0").alias("node"))
    seeds = nodes.filter("type = 'start'").select(F.col("id").alias("node"))
    reached = breadth_first(edges, seeds, None)
    lost = nodes.select(F.col("id").alias("node")).distinct().join(reached, "node", "left_anti").select(
        F.lit("unreachable").alias("problem"), "node"
    )
    return duplicates.unionByName(starts).unionByName(ends).unionByName(lost)
