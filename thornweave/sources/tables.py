"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.ranking import with_rank
from ..storage import materialise

COLOURS = ("cyan", "magenta", "yellow", "white")


def _no_props():
    return F.create_map().cast("map<string,string>")


def purchase_succession(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users who buy one after the other, undirected. add: days from the first purchase to the pair's first succession; mult counts them.

    A user's label is one of four colours and the score a digit, both by the id. Successors are found by rank, not by a
    window over all purchases.
    """
    bought = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").select("ts", "event_id", "user_id")
    ranked = materialise(with_rank(bought, "ts", "event_id"), "purchases")
    first = ranked.agg(F.min(F.to_date("ts")).alias("first"))
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("next"))
    pairs = ranked.join(following, "rank").filter("user_id <> next").crossJoin(F.broadcast(first))  # first is one row
    edges = pairs.groupBy(F.least("user_id", "next").alias("src"), F.greatest("user_id", "next").alias("dst")).agg(F.min(F.datediff(F.to_date("ts"), "first")).cast("long").alias("add"), F.count("*").alias("mult"))
    edges = materialise(edges, "successions")
    users = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    label = F.element_at(F.array(*map(F.lit, COLOURS)), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    vertices = users.select("id", label.alias("label"), F.create_map(F.lit("score"), F.pmod("id", F.lit(10)).cast("string")).alias("props"))
    kind = F.when(F.col("mult") > 1, "often").otherwise("once")
    full = edges.select("src", "dst", F.lit(0).alias("key"), kind.alias("label"), "add", F.create_map(F.lit("mult"), F.col("mult").cast("string")).alias("props"))
    return PropertyGraph(vertices, full)


def parallel_successions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The same users, with a second parallel edge labelled `again` for pairs that succeed each other more than once."""
    graph = purchase_succession(spark, sf_dir)
    again = graph.edges.filter("label = 'often'").select("src", "dst", F.lit(1).alias("key"), F.lit("again").alias("label"), "add", "props")
    return PropertyGraph(graph.vertices, graph.edges.union(again), False, True)


def nation_trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """From customers' nations to their suppliers', directed; vertices are nations labelled by region, with self-loops left out."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    bought = read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    ends = bought.join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src")), "o_custkey").join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst")), "l_suppkey")
    edges = ends.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("mult"))
    full = edges.select("src", "dst", F.lit(0).alias("key"), F.lit("trade").alias("label"), F.lit(None).cast("long").alias("add"), F.create_map(F.lit("mult"), F.col("mult").cast("string")).alias("props"))
    nations = read("nation").join(read("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    vertices = nations.select(F.col("n_nationkey").cast("long").alias("id"), F.col("r_name").alias("label"), _no_props().alias("props"))
    return PropertyGraph(vertices, full, True)


