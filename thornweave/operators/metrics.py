"""Counts over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .components import connected_components


def sizes(graph: PropertyGraph) -> DataFrame:
    """One row: vertices, edges."""
    return graph.vertices.agg(F.count("*").alias("vertices")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))  # one row each


def degrees(graph: PropertyGraph) -> DataFrame:
    """(id, degree): ends of edges at a vertex, a loop's both; 0 for a vertex alone."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_distribution(graph: PropertyGraph) -> DataFrame:
    return degrees(graph).groupBy("degree").agg(F.count("*").alias("vertices"))


def star_centres(graph: PropertyGraph, leaves: int = 4) -> DataFrame:
    """Vertices with so many different neighbours or more."""
    near = graph.adjacency(both=True).filter("src <> dst").select("src", "dst").distinct()
    return near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours")).filter(F.col("neighbours") >= leaves)


def triangles(graph: PropertyGraph) -> DataFrame:
    """(a, b, c) for each triangle, direction and parallel edges ignored.

    Edges point from the end with fewer neighbours to the one with more, so that a hub has few of its own and no
    vertex pairs up more than the square root of twice the number of edges.
    """
    pairs = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    at = pairs.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    out = at.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    corners = out.join(out.select("u", F.col("v").alias("w")), "u").filter("v < w")
    closed = corners.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    x, y, z = (F.array_sort(F.array("u", "v", "w"))[i] for i in range(3))
    return closed.select(x.alias("a"), y.alias("b"), z.alias("c"))


def triangle_count(graph: PropertyGraph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def components(graph: PropertyGraph) -> DataFrame:
    """(id, component) of all vertices; one without edges is a component of its own."""
    found = connected_components(graph.edges)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(graph: PropertyGraph) -> DataFrame:
    """(component, size): largest first, the smaller id first among equals."""
    return components(graph).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def component_size_summary(graph: PropertyGraph) -> DataFrame:
    """One row: median and largest size of components with more than one vertex."""
    sizes_ = components(graph).groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return sizes_.agg(F.percentile("size", 0.5).alias("median_size"), F.max("size").alias("largest_size"))


def density(graph: PropertyGraph) -> DataFrame:
    """One row: edges for each vertex."""
    return sizes(graph).select((F.col("edges") / F.col("vertices")).alias("density"))


def steps(graph: PropertyGraph) -> DataFrame:
    """(add, edges): the steps that there are, with their numbers of edges."""
    return graph.edges.filter("add IS NOT NULL").groupBy("add").agg(F.count("*").alias("edges"))


def first_seen(graph: PropertyGraph) -> DataFrame:
    """(id, first_step): when each vertex's first edge comes."""
    ends = graph.edges.filter("add IS NOT NULL").select(F.explode(F.array("src", "dst")).alias("id"), "add")
    return ends.groupBy("id").agg(F.min("add").alias("first_step"))


def added_first(ids: DataFrame, known: DataFrame) -> DataFrame:
    """ids (a column id) with known ones before others: known has id and rank, which is their order."""
    return ids.join(known.select("id", "rank"), "id", "left").orderBy(F.col("rank").isNull(), "rank", "id")
