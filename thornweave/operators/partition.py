"""Cutting a graph into parts that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..storage import materialise
from .community import split_once
from .metrics import components
from .ranking import with_rank


def balanced_parts(graph: PropertyGraph, parts: int) -> DataFrame:
    """(id, part): parts 0 ... parts - 1 whose sizes differ by one at most, neighbours together where they can be.

    Vertices are put in an order of component, community and id, and the order is cut into even pieces.
    """
    whole = components(graph).withColumnRenamed("component", "c0")
    placed = split_once(graph, whole).select("c0", "c", "id")
    ranked = materialise(with_rank(placed, "c0", "c", "id"), "placed")
    n = ranked.count()
    return ranked.select("id", F.floor(F.col("rank") * parts / F.lit(max(n, 1))).cast("int").alias("part"))


def halo(graph: PropertyGraph, members: DataFrame, depth: int) -> DataFrame:
    """(part, id, distance): members (part, id) of each part at distance 0, and what lies within `depth` edges around them."""
    ways = graph.adjacency(both=True).select(F.col("src").alias("id"), F.col("dst").alias("near")).distinct()
    seen = members.select("part", "id").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.select("part", "id").join(ways, "id").select("part", F.col("near").alias("id")).distinct()
        frontier = materialise(reached.join(seen, ["part", "id"], "left_anti").withColumn("distance", F.lit(d)), "halo")
        seen = seen.union(frontier)
    return seen


def overlapping_parts(graph: PropertyGraph, parts: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """((part, id, distance), (part, src, dst, key, label, add)): parts with their halos, and the edges within each."""
    members = materialise(halo(graph, balanced_parts(graph, parts), depth), "parts")
    edges = graph.edges.select("src", "dst", "key", "label", "add")
    inside = edges.join(members.select("part", F.col("id").alias("src")), "src").join(members.select("part", F.col("id").alias("dst")), ["part", "dst"])
    return members, inside.select("part", "src", "dst", "key", "label", "add")


def seed_chunks(seeds: DataFrame, chunks: int) -> DataFrame:
    """(id, chunk): contiguous runs of ids of even size."""
    ranked = materialise(with_rank(seeds.select("id").distinct(), "id"), "seeds")
    n = ranked.count()
    return ranked.select("id", F.floor(F.col("rank") * chunks / F.lit(max(n, 1))).cast("int").alias("chunk"))


def component_chunks(graph: PropertyGraph, chunks: int) -> DataFrame:
    """(component, chunk): components dealt by size, in turn there and back, so that chunks come out about even."""
    sized = components(graph).groupBy("component").agg(F.count("*").alias("size")).withColumn("less", -F.col("size"))
    ranked = with_rank(sized, "less", "component")
    turn, place = F.floor(F.col("rank") / chunks) % 2, F.col("rank") % chunks
    return ranked.select("component", "size", F.when(turn == 0, place).otherwise(chunks - 1 - place).cast("int").alias("chunk"))
