"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: vertices: one row per id. edges: undirected ones once; `key` tells parallel edges of a pair apart, `add` is their step.
VERTICES = "id long, label string, props map<string, string>"
EDGES = "src long, dst long, key int, label string, add long, props map<string, string>"


def missing_as_empty(value: Column) -> Column:
    """A missing label or property is the empty string, so that `!=` holds for it."""
    return F.coalesce(value, F.lit(""))


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    multi: bool = False

    # --- lookups -------------------------------------------------------------------------------------------------

    def vertex_labels(self) -> DataFrame:
        return self.vertices.select("id", missing_as_empty(F.col("label")).alias("label"))

    def vertex_property(self, key: str) -> DataFrame:
        return self.vertices.select("id", property_of(key).alias(key))

    def edge_labels(self) -> DataFrame:
        """(src, dst, labels): for each pair, the labels of its parallel edges by key."""
        entry = F.struct("key", missing_as_empty(F.col("label")).alias("label"))
        return self.pairs().groupBy("src", "dst").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"))

    def edge_property(self, key: str) -> DataFrame:
        return self.edges.select("src", "dst", "key", missing_as_empty(F.try_element_at("props", F.lit(key))).alias(key))

    def with_edge_label(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (src, dst) of which some parallel edge has the label; the empty label asks for nothing."""
        if not label:
            return pairs
        return pairs.join(self.adjacency(label).select("src", "dst").distinct(), ["src", "dst"], "left_semi")

    def filter_vertices(self, label: str = "", props: dict[str, str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """Ids whose label and properties are as given; without a label any will do. candidates: a column id."""
        found = self.vertices
        if label:
            found = found.filter(missing_as_empty(F.col("label")) == label)
        for key, value in (props or {}).items():
            found = found.filter(property_of(key) == value)
        return (found.join(candidates.select("id").distinct(), "id", "left_semi") if candidates is not None else found).select("id")

    def label_counts(self) -> dict[str, int]:
        """How many vertices have each label; one number a label comes to the driver."""
        return {r.label: r["count"] for r in self.vertex_labels().groupBy("label").count().collect()}

    # --- edges ---------------------------------------------------------------------------------------------------

    def pairs(self) -> DataFrame:
        """Edges with ends in canonical order where direction doesn't count."""
        if self.directed:
            return self.edges
        return self.edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})

    def adjacency(self, label: str = "", both: bool | None = None) -> DataFrame:
        """(src, dst, key, label, add) from each end that an edge can be left by; both: from either end though directed."""
        edges = self.edges.filter(missing_as_empty(F.col("label")) == label) if label else self.edges
        there = edges.select("src", "dst", "key", missing_as_empty(F.col("label")).alias("label"), "add")
        if self.directed and not both:
            return there
        back = there.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "key", "label", "add")
        return there.union(back)

    # --- parts and unions ----------------------------------------------------------------------------------------

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """The graph on the given ids (a column id) and the edges between them."""
        own = ids.select("id").distinct()
        edges = self.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, vertices=self.vertices.join(own, "id", "left_semi"), edges=edges.select(*self.edges.columns))

    def up_to(self, step: int) -> PropertyGraph:
        """The snapshot at a step. Edges without one are there from the start."""
        return self._with_ends(self.edges.filter(F.col("add").isNull() | (F.col("add") <= step)))

    def before(self, step: int, label: str | None = None) -> PropertyGraph:
        """Edges of earlier steps; label: one that all vertices get instead of theirs."""
        part = self._with_ends(self.edges.filter(F.coalesce("add", F.lit(0)) < step))
        return part if label is None else replace(part, vertices=part.vertices.withColumn("label", F.lit(label)))

    def base(self) -> PropertyGraph:
        """What is there at step 0."""
        return self._with_ends(self.edges.filter(F.coalesce("add", F.lit(0)) == 0))

    def _with_ends(self, edges: DataFrame) -> PropertyGraph:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return replace(self, vertices=self.vertices.join(ends, "id", "left_semi"), edges=edges)

    def plus(self, delta: DataFrame, vertices: DataFrame | None = None) -> PropertyGraph:
        """With more edges (each pair and key once, the first one stays) and more vertices (known ones stay as they are)."""
        tagged = self.edges.withColumn("new", F.lit(0)).unionByName(delta.select(*self.edges.columns).withColumn("new", F.lit(1)))
        a, b = ("src", "dst") if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        first = tagged.groupBy(F.col(a).alias("a") if self.directed else a.alias("a"), F.col(b).alias("b") if self.directed else b.alias("b"), "key").agg(F.min_by(F.struct(*self.edges.columns), "new").alias("e"))
        edges = first.select("e.*")
        known = self.vertices
        if vertices is not None:
            known = known.unionByName(vertices.join(known, "id", "left_anti").select(*known.columns))
        ends = delta.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(known, "id", "left_anti")
        return replace(self, vertices=known.unionByName(ends.select("id", F.lit("").alias("label"), F.create_map().cast("map<string,string>").alias("props"))), edges=edges)

    def attach(self, ids: DataFrame) -> DataFrame:
        """The vertices' rows for ids, empty where an id has none."""
        return ids.select("id").join(self.vertices, "id", "left").select("id", missing_as_empty(F.col("label")).alias("label"), "props")


def property_of(key: str) -> Column:
    """A vertex's property; `label` is its label."""
    return missing_as_empty(F.col("label") if key == "label" else F.try_element_at("props", F.lit(key)))


def graph_of(spark, vertices, edges, directed: bool = False, multi: bool = False) -> PropertyGraph:
    """From small lists: vertices (id, label[, props]), edges (src, dst[, label[, add]]). Parallel edges are numbered."""
    v = [(x[0], x[1], x[2] if len(x) > 2 else {}) for x in vertices]
    seen: dict = {}
    e = []
    for x in edges:
        pair = (x[0], x[1]) if directed else (min(x[:2]), max(x[:2]))
        key = seen[pair] = seen.get(pair, -1) + 1
        e.append((x[0], x[1], key, x[2] if len(x) > 2 else "", x[3] if len(x) > 3 else None, {}))
    return PropertyGraph(spark.createDataFrame(v, VERTICES), spark.createDataFrame(e, EDGES), directed, multi)
