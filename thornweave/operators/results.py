"""What is done with matches: properties by symbol, order, groups, aggregates, duplicates, equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, property_of

_AGGREGATES = {"MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg}


class ResultError(ValueError):
    pass


def reference(text: str) -> tuple[str, str]:
    symbol, dot, key = text.partition(".")
    if not (symbol and dot and key):
        raise ResultError(f"{text} isn't symbol.property")
    return symbol, key


def with_properties(matches: DataFrame, graph: PropertyGraph, references: list[str]) -> DataFrame:
    """matches with a text column `symbol.property` for each reference; empty where the vertex lacks it."""
    for symbol in dict.fromkeys(reference(r)[0] for r in references):
        keys = [k for s, k in dict.fromkeys(map(reference, references)) if s == symbol]
        if f"v_{symbol}" not in matches.columns:
            raise ResultError(f"the query has no vertex {symbol}")
        own = graph.vertices.select(F.col("id").alias(f"v_{symbol}"), *[property_of(k).alias(f"{symbol}.{k}") for k in keys])
        matches = matches.join(own, f"v_{symbol}", "left").fillna("", [f"`{symbol}.{k}`" for k in keys])
    return matches


def parse_aggregate(text: str) -> tuple[str, str | None]:
    """(COUNT, None) or (MIN | MAX | SUM | AVG, symbol.property)."""
    op, colon, of = text.partition(":")
    if op == "COUNT" and not colon:
        return op, None
    if op not in _AGGREGATES:
        raise ResultError(f"no aggregate {op}; there are COUNT, {', '.join(_AGGREGATES)}")
    reference(of)
    return op, of


def _number(text: str) -> Column:
    return F.col(f"`{text}`").try_cast("double")


def aggregated(matches: DataFrame, graph: PropertyGraph, aggregates: list[str], groupby: list[str] = ()) -> DataFrame:
    """One row, or one for each group, with a column for each aggregate, named as it is written.

    Without matches and groups all aggregates are null, COUNT too. Properties that are no numbers don't count for MIN, MAX, SUM
    and AVG.
    """
    parsed = [parse_aggregate(a) for a in aggregates]
    full = with_properties(matches, graph, [of for _, of in parsed if of] + list(groupby))
    columns = [(F.when(F.count("*") > 0, F.count("*")) if op == "COUNT" else _AGGREGATES[op](_number(of))).alias(text) for text, (op, of) in zip(aggregates, parsed, strict=True)]
    return full.groupBy(*[f"`{g}`" for g in groupby]).agg(*columns)


def grouped(matches: DataFrame, graph: PropertyGraph, groupby: list[str]) -> DataFrame:
    """The groups' keys and sizes."""
    return with_properties(matches, graph, list(groupby)).groupBy(*[f"`{g}`" for g in groupby]).agg(F.count("*").alias("size"))


def ordered(matches: DataFrame, graph: PropertyGraph, orderby: list[str], descending: bool = False) -> DataFrame:
    """By properties: numbers by value and before other texts (after them if descending); matches that are equal in all by canon_key."""
    full = with_properties(matches, graph, list(orderby))
    keys = [k for o in orderby for k in (_number(o).isNull(), _number(o), F.col(f"`{o}`"))]
    return full.orderBy(*[k.desc() if descending else k.asc() for k in keys], F.col("canon_key"))


def distinct(matches: DataFrame, by: str = "both") -> DataFrame:
    """One match for each subgraph, that with the smallest ids in the order of the query's symbols: by vertices and edges, by `edges` or by `vertices` alone."""
    key = {"both": "canon_key", "edges": "edges", "vertices": "vertices"}[by]
    first = [c for c in matches.columns if c.startswith("v_")]
    rest = [c for c in matches.columns if c not in (*first, key)]
    found = matches.groupBy(key).agg(F.min(F.struct(*first, *rest)).alias("_least"))
    return found.select(*[F.col(c) if c == key else F.col("_least")[c].alias(c) for c in matches.columns])


def one_per_seed(matches: DataFrame) -> DataFrame:
    """The first match of each seed, exact ones first."""
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("exact"), "canon_key"))).filter("_n = 1").drop("_n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """canon_key of the subgraphs that one of two results has and the other hasn't, and which: left or right."""
    x, y = (d.select("canon_key").distinct() for d in (a, b))
    return x.join(y, "canon_key", "left_anti").withColumn("side", F.lit("left")).union(y.join(x, "canon_key", "left_anti").withColumn("side", F.lit("right")))
