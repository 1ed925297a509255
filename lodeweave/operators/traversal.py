"""Breadth-first traversal with true depths, for one start or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import stored

#: Levels that a traversal goes at most.
MOST_DEPTH = 10


def reach(calls: DataFrame, starts: DataFrame, depth: int, direction: str = "callees", roots: bool = False) -> DataFrame:
    """(root, id, depth): what each start (id) reaches over calls, each node once at its least depth.

    ``direction`` callers goes against the edges, anything else along them. The start itself has depth 0
    and comes out only if ``roots``. Each level is one join of the frontier with the edges and one
    anti-join with what is known, materialised in the shared folder; it ends with an empty frontier.
    """
    at, to = ("dst", "src") if direction == "callers" else ("src", "dst")
    steps = calls.select(F.col(at).alias("id"), F.col(to).alias("next")).distinct()
    frontier = starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    seen = frontier
    for level in range(1, min(depth, MOST_DEPTH) + 1):
        found = frontier.join(steps, "id").select("root", F.col("next").alias("id")).distinct()
        frontier = stored(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen if roots else seen.where("depth > 0")


def depth_label(depth: Column) -> Column:
    return F.when(depth == 1, "Direct").when(depth == 2, "Indirect").otherwise("Transitive")


def flows(calls: DataFrame, entries: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(root, step, id): the flow of each entry, its nodes in the order of depth and id; steps from 0."""
    order = Window.partitionBy("root").orderBy("depth", "id")
    return reach(calls, entries, depth, roots=True).select("root", (F.row_number().over(order) - 1).alias("step"), "id")


def distinct_flows(steps: DataFrame) -> DataFrame:
    """(root, length, path_hash): flows without those that visit the same nodes in the same order; the least root stays."""
    keyed = steps.groupBy("root").agg(F.count("*").alias("length"), F.sum(F.xxhash64("step", "id").cast("decimal(38,0)")).alias("path_hash"))
    return keyed.groupBy("length", "path_hash").agg(F.min("root").alias("root")).select("root", "length", "path_hash")
