"""Best short paths.

A search that prefers vertices where the walk is often found, over paths of two edges at most, always ends in the edge itself
if there is one: the walk is at its source with probability 0.7 or more and everywhere else with 0.3 or less
together, so no detour scores higher. Otherwise it goes through the neighbour where the walk is most often found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph


def best_paths(graph: PropertyGraph, walk: DataFrame, label: str = "", sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, via, hops): the best path of one or two edges; via is null for one. The smaller via wins a tie.

    label: edges to go along. Sources without a row in the walk have no paths. A path never returns to its source.
    """
    ways = graph.adjacency(label).select("src", "dst").distinct().filter("src <> dst")
    start = ways.join(walk.filter(F.col("src") == F.col("dst")).select("src"), "src", "left_semi")
    if sources is not None:
        start = start.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    first = start.join(walk, ["src", "dst"]).select("src", F.col("dst").alias("via"), "p")
    second = first.join(ways.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst")
    two = second.groupBy("src", "dst").agg(F.min_by("via", F.struct((-F.col("p")).alias("p"), "via")).alias("via"))
    one = start.select("src", "dst", F.lit(None).cast("long").alias("via"), F.lit(1).alias("hops"))
    return two.join(start, ["src", "dst"], "left_anti").select("src", "dst", "via", F.lit(2).alias("hops")).union(one)


def update(old: DataFrame, graph: PropertyGraph, walk: DataFrame, sources: DataFrame, label: str = "") -> DataFrame:
    """Paths of the sources computed anew, all others as they were."""
    kept = old.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_anti")
    return kept.select("src", "dst", "via", "hops").union(best_paths(graph, walk, label, sources))


def as_vertices(paths: DataFrame) -> DataFrame:
    """With `path`: the vertices after src."""
    return paths.withColumn("path", F.when(F.col("via").isNull(), F.array("dst")).otherwise(F.array("via", "dst")))
