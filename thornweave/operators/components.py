"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ROWS_A_FILE, fresh_path, in_arrow, materialise, remove


#: Edges of which a task keeps a spanning forest before the rounds begin.
TOGETHER = 500_000


class Groups:
    """Disjoint sets, each named by its least member."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def name(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Joins the sets of two members; False if they are one already."""
        a, b = self.name(a), self.name(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


    def stars(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Each member with the name of its set, but for that member itself."""
        found = [(x, top) for x in self.above if (top := self.name(x)) != x]
        for i in range(0, len(found), 50_000):
            xs, tops = zip(*found[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(tops, pa.int64())], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each vertex with the least one that it reaches by them."""
    groups = Groups()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            groups.join(u, v)
    yield from groups.stars(["u", "v"])


def _to_least(pairs: DataFrame) -> DataFrame:
    """Joins to each (u, v) the least of u and all its v. Hot u are summed up before the shuffle and split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v."""
    linked = _to_least(edges)
    return linked.select(F.col("u"), F.col("m").alias("v")).union(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", about: int | None = None) -> DataFrame:
    """(id, component) for every id in edges; component is the least id that can be reached, direction ignored.

    First each task turns TOGETHER edges into stars by itself, which leaves an edge a vertex and task at most. Each round then
    turns the edges into stars around ever smaller ids, so the rounds grow with the logarithm of the longest path, and
    no round makes more edges than it was given. Every round ends in a table in the shared folder; the
    last but one is deleted. Edges with a null end are ignored; a self-loop makes its id a component. about: how many edges
    there may be, where that is known; it decides alone into how many files they are written at first.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = ends.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    path = fresh_path(spark, "stars")
    if about is not None:
        pairs = pairs.coalesce(max(1, -(-about // ROWS_A_FILE)))
    pairs.write.parquet(path)
    read = spark.read.schema(pairs.schema).parquet
    loops = read(path).filter("u = v").select(F.col("u").alias("id"))
    first, seen = path, None
    edges_, path = read(path).filter("u <> v"), fresh_path(spark, "stars")
    tasks = -(-edges_.count() // TOGETHER) or 1  # no round makes more edges, so as many files will do for each
    edges_.repartition(tasks).transform(in_arrow(_forest, "u long, v long")).write.parquet(path)
    while True:
        now = read(path).filter("u <> v")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        following = fresh_path(spark, "stars")
        _small_star(_large_star(now).distinct()).distinct().coalesce(tasks).write.parquet(following)
        if path != first:
            remove(spark, path)
        path = following
    stars = read(path).filter("u <> v")
    found = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    alone = loops.join(found.union(roots).select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(roots).union(alone)


def updated(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) after more edges; known: (id, component) before, as connected_components() gives it.

    The new edges are lifted to the components of their ends, so only what they touch is joined anew; all else keeps its component.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    of = known.select("id", "component")
    at_a = ends.join(of.toDF("a", "at_a"), "a", "left").select(F.coalesce("at_a", "a").alias("u"), "b")
    lifted = at_a.join(of.toDF("b", "at_b"), "b", "left").select("u", F.coalesce("at_b", "b").alias("v"))
    joined = materialise(connected_components(lifted, "u", "v").toDF("component", "now"), "components")
    moved = of.join(joined, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    new = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(of, "id", "left_anti")
    return moved.union(new.join(joined.toDF("id", "component"), "id").select("id", "component"))
