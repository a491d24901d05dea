"""Graphs from and to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, missing_as_empty
from ..operators.ranking import with_rank

_NODE_LINK = "directed boolean, multigraph boolean, nodes array<map<string, string>>, links array<map<string, string>>"


def _numbered(edges: DataFrame, directed: bool) -> DataFrame:
    """Parallel edges without a key get 0, 1, ... within their pair, in the order that they come in."""
    a, b = ("src", "dst") if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    n = F.row_number().over(Window.partitionBy(a, b).orderBy("at")) - 1
    return edges.withColumn("key", F.coalesce("key", n.cast("int")))


def _props(entry, known: tuple[str, ...]):
    return F.map_filter(entry, lambda k, v: ~k.isin(*known) & v.isNotNull())


def read_node_link(spark: SparkSession, path: str) -> PropertyGraph:
    """Node-link JSON: one document with nodes (id, ...) and links (source, target, ...); other keys become properties.

    Values are read as text whatever their type; nodes without a label get the empty one, links without `add` have no step.
    """
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", _NODE_LINK).alias("g")).select("g.*")
    head = doc.select(F.coalesce("directed", F.lit(False)).alias("directed"), F.coalesce("multigraph", F.lit(False)).alias("multi")).first()
    node, link = F.col("n"), F.col("l")
    vertices = doc.select(F.explode("nodes").alias("n")).select(
        node["id"].cast("long").alias("id"), missing_as_empty(F.try_element_at(node, F.lit("label"))).alias("label"), _props(node, ("id", "label")).alias("props")
    )
    edges = doc.select(F.posexplode("links").alias("at", "l")).select(
        "at",
        link["source"].cast("long").alias("src"),
        link["target"].cast("long").alias("dst"),
        F.try_element_at(link, F.lit("key")).cast("int").alias("key"),
        missing_as_empty(F.try_element_at(link, F.lit("label"))).alias("label"),
        F.try_element_at(link, F.lit("add")).try_cast("double").cast("long").alias("add"),
        _props(link, ("source", "target", "key", "label", "add")).alias("props"),
    )
    keyed = _numbered(edges, head.directed).select("src", "dst", "key", "label", "add", "props")
    return PropertyGraph(vertices, keyed, head.directed, head.multi)


def node_link(graph: PropertyGraph) -> DataFrame:
    """One row, `value`: the graph as node-link JSON. For graphs that one document can hold."""
    def entry(columns: list[str]):
        return F.to_json(F.struct(*[F.col(c) for c in columns])), F.to_json("props")

    def joined(own, props):
        return F.when(props.isNull() | (props == "{}"), own).otherwise(F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(","), F.expr("substring(props_, 2)")))

    def texts(df: DataFrame, names: dict[str, str], order: list[str]) -> DataFrame:
        own, props = entry(list(names.values()))
        renamed = df.select(*[F.col(c).alias(n) for c, n in names.items()], "props").select(own.alias("own"), props.alias("props_"), F.struct(*[names[o] for o in order]).alias("at"))
        return renamed.select(joined(F.col("own"), F.col("props_")).alias("t"), "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), ",").alias("list"))

    nodes = texts(graph.vertices, {"id": "id", "label": "label"}, ["id"]).withColumnRenamed("list", "nodes")
    links = texts(graph.edges, {"src": "source", "dst": "target", "key": "key", "label": "label", "add": "add"}, ["src", "dst", "key"]).withColumnRenamed("list", "links")
    head = json.dumps({"directed": graph.directed, "multigraph": graph.multi, "graph": {}})[:-1]
    return nodes.crossJoin(links).select(F.concat(F.lit(head + ', "nodes": ['), "nodes", F.lit('], "links": ['), "links", F.lit("]}")).alias("value"))  # one row each


def write_node_link(graph: PropertyGraph, path: str) -> None:
    node_link(graph).coalesce(1).write.mode("overwrite").text(path)


def write_edge_list(graph: PropertyGraph, path: str) -> None:
    graph.edges.select("src", "dst").write.mode("overwrite").option("sep", " ").csv(path)


def with_steps(edges: DataFrame, each: int) -> DataFrame:
    """edges (src, dst, at) with `add`: so many of them to a step, in the order of `at`."""
    return with_rank(edges, "at").withColumn("add", F.floor(F.col("rank") / each)).drop("rank")


def _graph(edges: DataFrame, label: str, edge_label: str, multi: bool) -> PropertyGraph:
    """edges: src, dst, add, at. Without multi, of several edges of a pair the last stays."""
    none = F.create_map().cast("map<string,string>")
    if multi:
        keyed = _numbered(edges.withColumn("key", F.lit(None).cast("int")), False)
    else:
        a, b = F.least("src", "dst"), F.greatest("src", "dst")
        keyed = edges.groupBy(a.alias("src"), b.alias("dst")).agg(F.max_by("add", "at").alias("add")).withColumn("key", F.lit(0))
    full = keyed.select("src", "dst", "key", F.lit(edge_label).alias("label"), F.col("add").cast("long").alias("add"), none.alias("props"))
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit(label).alias("label"), none.alias("props"))
    return PropertyGraph(vertices, full, False, multi)


def _lines(spark: SparkSession, path: str, names: str, **options) -> DataFrame:
    """Rows of a text file with `at`, which is their order in it; files of a folder come in the order of their names.

    Splits are read in any order, so the order is by file, place of the split in it, and row of the split.
    """
    split, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    order = F.concat_ws("\u0000", "_metadata.file_path", *[F.lpad(x.cast("string"), 20, "0") for x in (split, row)])
    raw = spark.read.schema(names).options(**options).csv(path)
    return raw.select(*raw.columns, order.alias("at"))


def read_edge_list(spark: SparkSession, path: str, each: int, label: str = "cyan", edge_label: str = "yes") -> PropertyGraph:
    """`src dst` on a line; steps of `each` lines. A pair that comes again is moved to its last step."""
    lines = _lines(spark, path, "src long, dst long", sep=" ").filter("src IS NOT NULL AND dst IS NOT NULL")
    return _graph(with_steps(lines, each), label, edge_label, False)


def read_timed_edge_list(spark: SparkSession, path: str, until: int | None = None, label: str = "cyan", edge_label: str = "yes") -> PropertyGraph:
    """`src dst seconds` on a line, in order of time; days since the first line. until: reading stops at the first later day."""
    lines = _lines(spark, path, "src long, dst long, ts long", sep=" ").filter("ts IS NOT NULL")
    day = F.floor(F.col("ts") / 86400)
    base = lines.select(F.min_by(day, "at")).first()[0]
    timed = lines.withColumn("add", day - F.lit(base))
    if until is not None:
        stop = timed.filter(F.col("add") > until).agg(F.min("at")).first()[0]
        timed = timed if stop is None else timed.filter(F.col("at") < stop)
    return _graph(timed, label, edge_label, False)


def read_timestamped(spark: SparkSession, path: str) -> PropertyGraph:
    """`src dst seconds` on a line; days since the earliest; every line is an edge of its own."""
    lines = _lines(spark, path, "src long, dst long, ts long", sep=" ").filter("ts IS NOT NULL").withColumn("add", F.floor(F.col("ts") / 86400))
    return _rebased(lines)


def read_timestamp_csv(spark: SparkSession, path: str) -> PropertyGraph:
    """`'"2004-05-06 07:08:09",src,dst"'`: fields with stray quotes; days since the earliest; every line is an edge of its own."""
    raw = _lines(spark, path, "ts string, src string, dst string", sep=",", quote="'", escape="\\")
    clean = raw.select(*[F.trim(F.regexp_replace(c, '"', "")).alias(c) for c in ("ts", "src", "dst")], "at")
    day = F.datediff(F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss")).cast("date"), F.lit("1970-01-01").cast("date"))
    lines = clean.select(F.col("src").try_cast("long").alias("src"), F.col("dst").try_cast("long").alias("dst"), day.cast("long").alias("add"), "at")
    return _rebased(lines.filter("src IS NOT NULL AND dst IS NOT NULL AND add IS NOT NULL"))


def _rebased(lines: DataFrame) -> PropertyGraph:
    base = lines.agg(F.min("add")).first()[0]
    return _graph(lines.withColumn("add", F.col("add") - F.lit(base)), "", "", True)


def write_state(df: DataFrame, folder: str, name: str, step: int) -> str:
    """Keeps the state of a step beside those of others."""
    path = f"{folder}/{name}/step={step}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_state(spark: SparkSession, folder: str, name: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/step={step}")
