"""Subgraph matching as a chain of joins, one for each edge of the query.

A binding is a row: v_<symbol> for each bound vertex, k_<edge> for the key of each edge taken, p_<path> for the vertices that a
path goes through. Every step joins the adjacency of one query edge and filters, so Catalyst plans, broadcasts and
splits it like any join.

Modes:
    exact   all bindings of different vertices such that every query edge is an edge of the graph, and every path of the
            query a simple path of up to max_path_edges edges through vertices that no symbol is bound to
    greedy  from each bound vertex only to where the walk with restart is most often found, over best paths; what turns out exact
    approx  the same with what isn't exact, because a best path takes two edges where the query has one
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import condition as conditions
from ..graph import PropertyGraph, missing_as_empty, property_of
from ..plans.planner import order, symmetry_breaks
from ..plans.query import PatternQuery
from ..storage import materialise, small
from . import paths as best
from . import results
from . import walk as walks

MAX_PATH_EDGES = 3
NEAR = 1e-5


def _every(conditions_: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions_, F.lit(True))


class _Candidates:
    """Vertices that a symbol may be bound to, with the properties that the condition needs of it."""

    def __init__(self, graph: PropertyGraph, query: PatternQuery):
        self.graph, self.query = graph, query
        node = conditions.parse(query.condition) if query.condition.strip() else None
        self.conjuncts = [(c, {s for s, _ in c.references()}) for c in node.conjuncts()] if node else []
        self.needs = sorted({r for c, _ in self.conjuncts for r in c.references()})
        if unknown := {s for s, _ in self.needs} - set(query.vertices):
            raise conditions.ConditionError(f"the condition names what is no vertex: {sorted(unknown)}")

    def of(self, symbol: str) -> DataFrame | None:
        """None if any vertex will do and nothing about it is needed."""
        label = self.query.labels.get(symbol, "")
        needs = [k for s, k in self.needs if s == symbol]
        if not label and not needs:
            return None
        found = self.graph.vertices.filter(missing_as_empty(F.col("label")) == label) if label else self.graph.vertices
        return found.select(F.col("id").alias(f"v_{symbol}"), *[property_of(k).alias(f"c_{symbol}_{k}") for k in needs])

    def bound(self, bindings: DataFrame, symbol: str, before: set[str]) -> DataFrame:
        """Bindings whose new symbol fits, and that meet what can be said of the condition now."""
        if (own := self.of(symbol)) is not None:
            bindings = bindings.join(own, f"v_{symbol}")
        now = before | {symbol}
        for c, symbols in self.conjuncts:
            if symbols <= now and (symbol in symbols or (not symbols and not before)):
                bindings = bindings.filter(conditions.compile_(c, lambda s, k: F.col(f"c_{s}_{k}")))
        return bindings


def seeds_of(graph: PropertyGraph, query: PatternQuery, among: DataFrame | None = None) -> DataFrame:
    """Ids that the first symbol may be bound to; among: a column id."""
    return graph.filter_vertices(query.labels.get(query.vertices[0], ""), None, among)


def bindings(graph: PropertyGraph, query: PatternQuery, max_path_edges: int = MAX_PATH_EDGES, seeds: DataFrame | None = None, edges_of: dict[str, DataFrame] | None = None, constraints=((), ()), first_edge: str | None = None, selectivity: dict[str, int] | None = None, first_rows: int | None = None) -> DataFrame:
    """All exact bindings: columns v_, k_ and p_.

    seeds: ids (a column id) for the symbol that is bound first. edges_of: by a query edge's name, the adjacency (src, dst, key, label, add)
    to take it from instead of the whole graph's. constraints: symbols and edges of which the first has the smaller id or key.
    first_edge: an edge of the query to start from, by default the first symbol as written. selectivity: number of vertices by label,
    to go to rare ones first. first_rows: a bound on the first edge's rows, where it is known: few ones are broadcast to the second's. The graph's vertices hold every end of its edges.
    """
    candidates, less, keys = _Candidates(graph, query), constraints[0], constraints[1]
    steps = order(query, selectivity=selectivity, first_edge=first_edge)
    start = steps[0].frm

    def adjacency(edge, back: bool) -> DataFrame:
        ways = (edges_of or {}).get(edge.name)
        ways = graph.adjacency(edge.label) if ways is None else (ways.filter(F.col("label") == edge.label) if edge.label else ways)
        ways = ways.select("src", "dst", "key")
        return ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "key") if back and graph.directed else ways

    def fresh(symbol: str) -> Column:
        new = F.col(f"v_{symbol}")
        return _every([new != F.col(f"v_{b}") for b in bound] + [~F.array_contains(f"p_{p}", new) for p in inner])

    rows, bound, taken, inner = None, {start}, [], []
    if seeds is not None or steps[0].edge.path or steps[0].closes:  # else the first edge's own rows are the first bindings
        rows = graph.vertices.select(F.col("id").alias(f"v_{start}"))
        if seeds is not None:
            rows = rows.join(seeds.select(F.col("id").alias(f"v_{start}")).distinct(), f"v_{start}", "left_semi")
        rows = candidates.bound(rows, start, set())
    for step in steps:
        e = step.edge
        if e.path:
            rows = _along(rows, adjacency(e, step.back).select("src", "dst").distinct(), step, [f"v_{b}" for b in bound if b != step.to], [f"p_{p}" for p in inner], max_path_edges)
            inner.append(e.name)
        else:
            ways = adjacency(e, step.back).select(F.col("src").alias(f"v_{step.frm}"), F.col("dst").alias(f"v_{step.to}"), F.col("key").alias(f"k_{e.name}"))
            if step.frm == step.to:  # a loop
                ways = adjacency(e, False).filter("src = dst").select(F.col("src").alias(f"v_{step.frm}"), F.col("key").alias(f"k_{e.name}"))
            if rows is not None and first_rows is not None and step is steps[1]:
                rows = small(rows, first_rows)
            rows = candidates.bound(ways, start, set()) if rows is None else rows.join(ways, [f"v_{s}" for s in dict.fromkeys([step.frm, step.to] if step.closes else [step.frm])])
            if not step.closes:
                rows = rows.filter(fresh(step.to))
            for f in taken:
                if {f.src, f.dst} == {e.src, e.dst} and (not graph.directed or f.src == e.src):
                    rows = rows.filter(F.col(f"k_{e.name}") != F.col(f"k_{f.name}"))
            taken.append(e)
            rows = rows.filter(_every([F.col(f"k_{a}") < F.col(f"k_{b}") for a, b in keys if e.name in (a, b) and {a, b} <= {t.name for t in taken}]))
        if not step.closes:
            rows = candidates.bound(rows, step.to, bound)
            rows = rows.filter(_every([F.col(f"v_{x}") < F.col(f"v_{y}") for x, y in less if step.to in (x, y) and {x, y} <= bound | {step.to}]))
            bound.add(step.to)
    kept = [f"v_{s}" for s in query.vertices] + [f"k_{e.name}" for e in query.edges if not e.path] + [f"p_{e.name}" for e in query.edges if e.path]
    return rows.select(*kept)


def _along(rows: DataFrame, ways: DataFrame, step, others: list[str], inner: list[str], most: int) -> DataFrame:
    """Rows with a simple path from one symbol to the other; p_ has the vertices between, in the edge's own direction."""
    name, end = f"p_{step.edge.name}", f"v_{step.to}"
    at = rows.withColumn("_way", F.array().cast("array<long>")).withColumn("_at", F.col(f"v_{step.frm}"))
    hops = ways.select(F.col("src").alias("_at"), F.col("dst").alias("_next"))
    found = None
    for length in range(1, most + 1):
        on = at.join(hops, "_at")
        free = _every([F.col("_next") != F.col(o) for o in others] + [~F.array_contains(p, F.col("_next")) for p in inner + ["_way"]])
        through = F.reverse("_way") if step.back else F.col("_way")
        if step.closes:
            here = on.filter(F.col("_next") == F.col(end)).withColumn(name, through).drop("_at", "_next", "_way")
            free = free & (F.col("_next") != F.col(end))
        else:
            here = on.filter(free).withColumn(end, F.col("_next")).withColumn(name, through).drop("_at", "_next", "_way")
        found = here if found is None else found.unionByName(here)
        if length < most:
            at = on.filter(free).withColumn("_way", F.array_append("_way", F.col("_next"))).drop("_at").withColumnRenamed("_next", "_at")
    return found


def _edge(directed: bool, a: Column, b: Column, key: Column) -> Column:
    src, dst = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    return F.struct(src.cast("long").alias("src"), dst.cast("long").alias("dst"), key.cast("int").alias("key"))


def as_matches(rows: DataFrame, graph: PropertyGraph, query: PatternQuery) -> DataFrame:
    """seed, v_<symbol>, vertices, edges, exact, canon_key. A path's edges have no key: any of parallel ones will do."""
    direct = [_edge(graph.directed, F.col(f"v_{e.src}"), F.col(f"v_{e.dst}"), F.col(f"k_{e.name}")) for e in query.edges if not e.path]
    edges, vertices = F.array(*direct) if direct else F.array().cast("array<struct<src: bigint, dst: bigint, key: int>>"), F.array(*[F.col(f"v_{s}") for s in query.vertices])
    for e in query.edges:
        if e.path:
            way = F.concat(F.array(f"v_{e.src}"), F.col(f"p_{e.name}"), F.array(f"v_{e.dst}"))
            edges = F.concat(edges, F.zip_with(F.slice(way, 1, F.size(way) - 1), F.slice(way, 2, F.size(way) - 1), lambda a, b: _edge(graph.directed, a, b, F.lit(None))))
            vertices = F.concat(vertices, F.col(f"p_{e.name}"))
    return _finished(rows, query, F.array_sort(F.array_distinct(vertices)), F.array_sort(edges), F.lit(True))


def _finished(rows: DataFrame, query: PatternQuery, vertices: Column, edges: Column, exact: Column) -> DataFrame:
    own = rows.select(F.col(f"v_{query.vertices[0]}").alias("seed"), *[F.col(f"v_{s}") for s in query.vertices], vertices.alias("vertices"), edges.alias("edges"), exact.alias("exact"))
    key = F.concat(F.array_join(F.transform("vertices", lambda v: v.cast("string")), ","), F.lit("|"), F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["src"].cast("string"), e["dst"].cast("string"), F.coalesce(e["key"].cast("string"), F.lit("")))), ","))
    return own.withColumn("canon_key", key)


def exact(graph: PropertyGraph, query: PatternQuery, max_path_edges: int = MAX_PATH_EDGES, distinct: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """All matches; distinct: one for each subgraph.

    For distinct subgraphs the query's symmetries are broken while matching, so most images of a subgraph are never made; what
    that can't tell apart is dropped afterwards. With a condition or seeds every image counts, and duplicates are dropped.
    """
    if not distinct:
        return as_matches(bindings(graph, query, max_path_edges, seeds), graph, query)
    free = not query.condition.strip() and seeds is None
    less, keys, complete = symmetry_breaks(query) if free else ([], [], False)
    found = as_matches(bindings(graph, query, max_path_edges, seeds, constraints=(less, keys)), graph, query)
    return found if complete else results.distinct(found)


def count(graph: PropertyGraph, query: PatternQuery, max_path_edges: int = MAX_PATH_EDGES) -> DataFrame:
    """One row: the number of bindings, which are never written out."""
    return bindings(graph, query, max_path_edges).agg(F.count("*").alias("matches"))


def expand(rows: DataFrame, frm: str, to: str, walk: DataFrame, candidates: DataFrame, bound: list[str], back: bool = False, touched: str | None = None) -> DataFrame:
    """Each row with the candidates (a column id) where the walk from `frm` is most often found, all within a small tolerance.

    back: where the walk from the candidate finds `frm`. bound: columns whose vertices are taken; touched: a column with more of them.
    """
    row = F.struct(*rows.columns)
    a, b = ("dst", "src") if back else ("src", "dst")
    near = walk.select(F.col(a).alias(frm), F.col(b).alias(to), "p").join(candidates.select(F.col("id").alias(to)), to, "left_semi")
    free = _every([F.col(to) != F.col(c) for c in bound] + ([~F.array_contains(touched, F.col(to))] if touched else []))
    good = rows.withColumn("_row", row).join(near, frm).filter(free).withColumn("_good", F.log(F.col("p") + 1e-10))
    top = good.withColumn("_top", F.max("_good").over(Window.partitionBy("_row")))
    return top.filter(F.col("_good") >= F.col("_top") - NEAR).drop("_row", "_good", "_top", "p")


def guided(graph: PropertyGraph, query: PatternQuery, walk: DataFrame | None = None, approximate: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """Greedy matches, and with approximate those too that take two edges for one of the query.

    A row's result graph grows by a best path for each query edge and is given up once it has more edges than the query
    while query edges are left. It is exact if it has as many edges and vertices as the query; with path edges, if every
    symbol has a vertex of its own. A path edge leads to every vertex that a best path reaches, if its label fits.
    """
    walk = materialise(walks.random_walk(graph), "walk") if walk is None else walk
    ways = materialise(best.as_vertices(best.best_paths(graph, walk)), "best-paths")
    candidates = _Candidates(graph, query)
    start = query.vertices[0]
    own = graph.vertices.select(F.col("id").alias(f"v_{start}"))
    if seeds is not None:
        own = own.join(seeds.select(F.col("id").alias(f"v_{start}")).distinct(), f"v_{start}", "left_semi")
    rows = candidates.bound(own, start, set()).withColumn("_edges", F.array().cast("array<struct<src: bigint, dst: bigint, key: int>>")).withColumn("_touched", F.array(f"v_{start}"))
    bound, steps = [start], order(query)
    for i, step in enumerate(steps):
        e, frm, to = step.edge, f"v_{step.frm}", f"v_{step.to}"
        if step.frm == step.to:
            continue  # a loop adds nothing here
        allowed = graph.filter_vertices(query.labels.get(step.to, ""))
        src, dst = (to, frm) if step.back and graph.directed else (frm, to)
        over = (best.as_vertices(best.best_paths(graph, walk, e.label)) if e.path and e.label else ways).select(F.col("src").alias(src), F.col("dst").alias(dst), F.col("path").alias("_path"))
        if not step.closes and not e.path:
            rows = expand(rows, frm, to, walk, allowed, [f"v_{b}" for b in bound], step.back and graph.directed, "_touched")
        rows = rows.join(over, [src, dst] if step.closes or not e.path else [frm])
        if not step.closes and e.path:
            rows = rows.join(allowed.withColumnRenamed("id", to), to, "left_semi").filter(_every([F.col(to) != F.col(f"v_{b}") for b in bound]))
        whole = F.concat(F.array(src), F.col("_path"))
        hops = F.zip_with(F.slice(whole, 1, F.size("_path")), F.col("_path"), lambda a, b: _edge(graph.directed, a, b, F.lit(None)))
        rows = rows.withColumn("_hops", hops)
        if e.label and not e.path:
            rows = _labelled(rows, graph, e.label)
        rows = rows.withColumn("_edges", F.concat("_edges", "_hops")).withColumn("_touched", F.array_distinct(F.concat("_touched", "_path", F.array(src)))).drop("_path", "_hops")
        if i + 1 < len(steps):
            rows = rows.filter(F.size("_edges") <= len(query.edges))
        if not step.closes:
            rows = candidates.bound(rows, step.to, set(bound))
            bound.append(step.to)
    vertices, loops = F.array_sort("_touched"), sum(e.src == e.dst for e in query.edges)
    as_drawn = (F.size("_edges") == len(query.edges) - loops) & (F.size("_touched") == len(query.vertices))
    if query.has_path:
        as_drawn = F.size(F.array_distinct(F.array(*[F.col(f"v_{s}") for s in query.vertices]))) == len(query.vertices)
    found = _finished(rows, query, vertices, F.array_sort("_edges"), as_drawn)
    return found if approximate else found.filter("exact")


def _labelled(rows: DataFrame, graph: PropertyGraph, label: str) -> DataFrame:
    """Rows of which each hop has a parallel edge with the label."""
    marked = graph.adjacency(label).select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct().withColumn("_there", F.lit(True))
    for i in range(2):
        hop = F.get("_hops", F.lit(i))
        met = rows.withColumn("_s", hop["src"]).withColumn("_d", hop["dst"]).join(marked, ["_s", "_d"], "left")
        rows = met.filter(F.col("_there") | F.col("_s").isNull()).drop("_s", "_d", "_there")
    return rows


def rank_seeds(graph: PropertyGraph, query: PatternQuery, walk: DataFrame) -> DataFrame:
    """(id, goodness): vertices for the first symbol that are best placed, all within a small tolerance.

    For each neighbour of the symbol in the query, the logarithms of how often the walk from each vertex with its label finds the
    candidate, divided by the number of neighbours, are added up and set against how often a walk in the query itself
    goes that way. A vertex that the walk doesn't come from counts as 1e-10.
    """
    k = query.vertices[0]
    near = list(dict.fromkeys([e.dst if e.src == k else e.src for e in query.edges if k in (e.src, e.dst) and e.src != e.dst and (not query.directed or e.src == k)]))
    seeds = seeds_of(graph, query)
    total = None
    for symbol in near:
        share = walk_in_query(query, symbol).get(k, 0.0) or 1e-10
        others = graph.filter_vertices(query.labels.get(symbol, ""))
        n = others.count()
        found = walk.join(others.withColumnRenamed("id", "src"), "src", "left_semi").join(seeds.withColumnRenamed("id", "dst"), "dst", "left_semi")
        sums = found.groupBy(F.col("dst").alias("id")).agg(F.sum(F.log(F.col("p") / len(near) + 1e-10)).alias("s"), F.count("*").alias("n"))
        floor = F.log(F.lit(1e-10))
        own = seeds.join(sums, "id", "left").select("id", ((F.coalesce("s", F.lit(0.0)) + (F.lit(n) - F.coalesce("n", F.lit(0))) * floor) / F.lit(share)).alias("g"))
        total = own if total is None else total.union(own)
    if total is None:
        return seeds.select("id", F.lit(0.0).alias("goodness"))
    good = total.groupBy("id").agg(F.sum("g").alias("goodness"))
    top = good.agg(F.max("goodness").alias("top"))
    return good.crossJoin(F.broadcast(top)).filter(F.col("goodness") >= F.col("top") - NEAR).select("id", "goodness")  # top is one row


def walk_in_query(query: PatternQuery, source: str) -> dict[str, float]:
    """The walk with restart from a symbol over the query's own edges, on the driver."""
    out: dict[str, list[str]] = {v: [] for v in query.vertices}
    for e in query.edges:
        out[e.src].append(e.dst)
        if not query.directed and e.src != e.dst:
            out[e.dst].append(e.src)
    p = {source: 1.0}
    for _ in range(walks.MOST_STEPS):
        new = {source: walks.RESTART}
        for v, x in p.items():
            for w in out[v]:
                new[w] = new.get(w, 0.0) + x * (1 - walks.RESTART) / len(out[v])
        change = sum(abs(new.get(v, 0.0) - p.get(v, 0.0)) for v in {*new, *p})
        p = new
        if change <= walks.TOLERANCE:
            break
    return p


def find(graph: PropertyGraph, query: PatternQuery, mode: str = "exact", distinct: bool = True, per_seed: bool = False, max_path_edges: int = MAX_PATH_EDGES, seeds: DataFrame | None = None, walk: DataFrame | None = None) -> DataFrame:
    """Matches in a mode: exact, greedy or approx; per_seed: one for each vertex of the first symbol."""
    if mode == "exact":
        found = exact(graph, query, max_path_edges, distinct and not per_seed, seeds)
    elif mode in ("greedy", "approx"):
        found = guided(graph, query, walk, mode == "approx", seeds)
        found = results.distinct(found) if distinct and not per_seed else found
    else:
        raise ValueError(f"no mode {mode}")
    return results.one_per_seed(found) if per_seed else found
