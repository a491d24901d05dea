"""Communities by modularity, refined until they are small, and what a change to the graph affects.

Vertices move to the neighbouring community that raises modularity most. All moves of a round are made at once, so that a
round is a few joins; so that two vertices don't swap places for ever, only vertices of one parity of a hash move in a round, and
moves that raise nothing are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..storage import materialise

ROUNDS = 12


def _weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) both ways without loops; parallel edges add up."""
    both = edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _moved(weights: DataFrame, strength: DataFrame, part: DataFrame, within: DataFrame, parity: int) -> DataFrame:
    """part (id, c) after one round; within: (c0, m2) total weight of the cluster that a vertex may move in."""
    own = part.join(strength, "id")
    totals = own.groupBy("c").agg(F.sum("k").alias("total"))
    at = weights.join(part.select(F.col("id").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("links"))
    # a vertex alone among strangers may also stay: its own community counts with the links it has there
    stay = own.select("id", F.col("c").alias("to"), F.lit(0.0).alias("links"))
    options = at.union(stay).groupBy("id", "to").agg(F.max("links").alias("links"))
    scored = options.join(own.select("id", "c", "k", "c0"), "id").join(totals.select(F.col("c").alias("to"), "total"), "to").join(within, "c0")
    rest = F.col("total") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    gain = F.col("links") - F.col("k") * rest / F.col("m2")
    best = scored.withColumn("gain", F.round(gain, 9)).groupBy("id").agg(
        F.min_by("to", F.struct((-F.col("gain")).alias("g"), (F.col("to") != F.col("c")).alias("moves"), "to")).alias("to"),
    )
    turn = F.pmod(F.hash("id"), F.lit(2)) == parity
    return part.join(best, "id", "left").select("id", F.when(turn & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("c")).alias("c"))


def split_once(graph: PropertyGraph, clusters: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, c0, c): each cluster (id, c0) cut into communities of its own, named by a member. Vertices without edges stay alone."""
    ends = clusters.select(F.col("id").alias("src"), F.col("c0").alias("a")), clusters.select(F.col("id").alias("dst"), F.col("c0").alias("b"))
    inside = graph.edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").filter("a = b").select("src", "dst")
    weights = materialise(_weights(inside), "weights")
    strength = materialise(clusters.join(weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "id", "left").select("id", "c0", F.coalesce("k", F.lit(0.0)).alias("k")), "strength")
    within = strength.groupBy("c0").agg(F.greatest(F.sum("k"), F.lit(1.0)).alias("m2"))
    part = strength.select("id", F.col("id").alias("c"))
    previous = None
    for i in range(rounds):
        part = materialise(_moved(weights, strength, part, within, i % 2), "communities")
        state = tuple(part.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first())
        if previous is not None and state == previous:
            break
        previous = state if i % 2 else previous  # both parities have had their turn
    return part.join(strength.select("id", "c0"), "id").select("id", "c0", "c")


def recursive_communities(graph: PropertyGraph, least: int, rounds: int = ROUNDS, depth: int = 20) -> DataFrame:
    """(id, community): communities cut again until each has fewer than `least` vertices or doesn't come apart.

    All clusters of a depth are cut by the same jobs. A community is named by its smallest member.
    """
    pending = graph.vertices.select("id", F.lit(0).cast("long").alias("c0"))
    done = None
    for _ in range(depth):
        cut = split_once(graph, pending, rounds)
        size = cut.groupBy("c0", "c").agg(F.count("*").alias("n"))
        pieces = size.groupBy("c0").agg(F.count("*").alias("pieces"))
        judged = materialise(cut.join(size, ["c0", "c"]).join(pieces, "c0"), "cut")
        ready = (F.col("pieces") == 1) | (F.col("n") < least)
        found = judged.filter(ready).select("id", "c0", "c")
        done = found if done is None else done.union(found)
        pending = judged.filter(~ready).select("id", F.col("c").alias("c0"))
        if pending.isEmpty():
            break
    else:
        done = done.union(pending.select("id", "c0", F.col("c0").alias("c")))
    names = done.groupBy("c0", "c").agg(F.min("id").alias("community"))
    return done.join(names, ["c0", "c"]).select("id", "community")


def affected(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (a column id) with all members of their communities; ids of no community are affected themselves."""
    touched = ids.select("id").distinct()
    hit = communities.join(touched, "id", "left_semi").select("community").distinct()
    return communities.join(hit, "community", "left_semi").select("id").union(touched).distinct()


def affected_counts(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: communities that ids touch, and all of them."""
    hit = communities.join(ids.select("id").distinct(), "id", "left_semi").agg(F.countDistinct("community").alias("affected"))
    return hit.crossJoin(communities.agg(F.countDistinct("community").alias("total")))  # one row each


def modularity(graph: PropertyGraph, communities: DataFrame) -> float:
    w = _weights(graph.edges)
    ends = w.join(communities.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(communities.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    m2 = w.agg(F.sum("w")).first()[0] or 0.0
    if not m2:
        return 0.0
    inside = ends.filter("a = b").agg(F.sum("w")).first()[0] or 0.0
    squares = ends.groupBy("a").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / m2 - squares / (m2 * m2)
