"""Random walk with restart, for many sources at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..storage import materialise

RESTART = 0.7
TOLERANCE = 1e-3
#: A step moves the remaining 0.3 of the mass, so a change of 0.6 at most shrinks below the tolerance by the seventh.
MOST_STEPS = 7


def transition(graph: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(src, dst, w): shares by which a vertex passes on its mass; parallel edges add up, a vertex without a way out has no row."""
    if weight is None:
        moves = graph.adjacency().groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    else:
        own = graph.edges.select("src", "dst", F.coalesce(F.try_element_at("props", F.lit(weight)).try_cast("double"), F.lit(1.0)).alias("n"))
        back = own.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        moves = (own if graph.directed else own.union(back)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    total = moves.groupBy("src").agg(F.sum("n").alias("total"))
    return moves.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def step(p: DataFrame, w: DataFrame, sources: DataFrame, restart: float = RESTART, least: float = 0.0) -> DataFrame:
    """(src, dst, p) after one more step. least: entries below are dropped (their mass is lost)."""
    moved = p.join(w.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "w"), "dst").select("src", F.col("to").alias("dst"), (F.col("p") * F.col("w") * (1 - restart)).alias("p"))
    again = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(restart).alias("p"))
    total = moved.union(again).groupBy("src", "dst").agg(F.sum("p").alias("p"))
    return total.filter(F.col("p") > least) if least else total


def random_walk(graph: PropertyGraph, sources: DataFrame | None = None, tolerance: float = TOLERANCE, steps: int = MOST_STEPS, restart: float = RESTART, least: float = 0.0, weight: str | None = None) -> DataFrame:
    """(src, dst, p): where a walk from src is found that starts over with probability `restart` at each step.

    sources: a column id, by default all vertices. A source stops once a step changes its row by the tolerance or less, in the
    sum of absolute differences; with a tolerance of 0 all make the same number of steps. A null tolerance column never
    arises: what isn't reached has no row (read it as 0, see value()).
    """
    own = (graph.vertices if sources is None else sources).select("id").distinct()
    w = materialise(transition(graph, weight), "transition")
    p = own.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("p"))
    if tolerance <= 0:
        for i in range(steps):
            p = step(p, w, own, restart, least)
            if i % 3 == 2:
                p = materialise(p, "walk")
        return p
    done, active = None, own
    for i in range(steps):
        following = materialise(step(p, w, active, restart, least), "walk")
        if i == steps - 1:
            done = following if done is None else done.union(following)
            break
        change = p.withColumn("p", -F.col("p")).union(following).groupBy("src", "dst").agg(F.sum("p").alias("d")).groupBy("src").agg(F.sum(F.abs("d")).alias("change"))
        change = materialise(change, "walk-change")
        settled = change.filter(F.col("change") <= tolerance).select("src")
        ready = following.join(settled, "src", "left_semi")
        done = ready if done is None else done.union(ready)
        p = following.join(settled, "src", "left_anti")
        active = active.join(settled.withColumnRenamed("src", "id"), "id", "left_anti")
        if change.filter(F.col("change") > tolerance).isEmpty():
            break
    return done


def update(old: DataFrame, graph: PropertyGraph, sources: DataFrame, **options) -> DataFrame:
    """Rows of the sources computed anew, all others as they were."""
    new = random_walk(graph, sources, **options)
    return old.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select("src", "dst", "p").union(new.select("src", "dst", "p"))


def value(walk: DataFrame, pairs: DataFrame) -> DataFrame:
    """p for each (src, dst) of pairs; 0 where the walk doesn't come."""
    return pairs.join(walk, ["src", "dst"], "left").select(*pairs.columns, F.coalesce("p", F.lit(0.0)).alias("p"))


def ranked(walk: DataFrame) -> DataFrame:
    """With the rank of each destination from its source, the smaller id first among equals."""
    return walk.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("p"), "dst")))
