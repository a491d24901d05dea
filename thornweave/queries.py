"""The engine's queries over the driver's tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import community, match, metrics, partition, paths, results, walk
from .operators.ranking import with_rank
from .plans.query import parse
from .sources import tables
from .storage import materialise
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_USERS = """
WITH p AS (SELECT user_id, ts, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
e AS (
  SELECT least(user_id, nxt) AS src, greatest(user_id, nxt) AS dst, min(date_diff('day', (SELECT min(ts::DATE) FROM p), ts::DATE))::BIGINT AS add, count(*) AS mult
  FROM p WHERE nxt IS NOT NULL AND user_id <> nxt GROUP BY 1, 2
),
v AS (SELECT id, ['cyan', 'magenta', 'yellow', 'white'][id % 4 + 1] AS label, id % 10 AS score FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)),
adj AS (SELECT src, dst, add, mult FROM e UNION ALL SELECT dst, src, add, mult FROM e)
"""
_NATIONS = """
WITH e AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS mult FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
),
v AS (SELECT n_nationkey::BIGINT AS id, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _query(sql: str | None = None, over: str = _USERS, recursive: bool = False):
    """Registers a function under its name; sql goes on from the CTEs of `over`."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (over.replace("WITH", "WITH RECURSIVE", 1) if recursive else over) + sql
        return f

    return register


def _bindings(graph, text: str, distinct: bool = True) -> DataFrame:
    query = parse(text)
    found = match.exact(graph, query, distinct=distinct)
    return found.select(*[f"v_{s}" for s in query.vertices])


TRIANGLE = "--vertex a b c --edge x:a:b y:b:c z:c:a"


@_query("SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")
def match_triangle(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), TRIANGLE)


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON z.src = y.dst AND z.dst = x.src
JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst JOIN v c ON c.id = y.dst WHERE a.label = 'cyan' AND b.label = 'magenta' AND c.label = 'yellow'""")
def match_triangle_labelled(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), TRIANGLE + " --vertexlabel a:cyan b:magenta c:yellow")


@_query("SELECT x.src AS v_a, x.dst AS v_b FROM e x WHERE mult > 1")
def match_edge_label(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), "--vertex a b --edge x:a:b --edgelabel x:often")


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c, z.dst AS v_d FROM adj x JOIN adj y ON x.dst = y.src AND y.dst <> x.src JOIN adj z ON y.dst = z.src AND z.dst <> x.src AND z.dst <> x.dst
JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst JOIN v c ON c.id = y.dst JOIN v d ON d.id = z.dst
WHERE a.label = 'cyan' AND b.label = 'magenta' AND c.label = 'yellow' AND d.label = 'white'""")
def match_path3(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), "--vertex a b c d --edge x:a:b y:b:c z:c:d --vertexlabel a:cyan b:magenta c:yellow d:white")


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c, z.dst AS v_d FROM adj x JOIN adj y ON x.dst = y.src AND y.dst > x.src JOIN adj z ON y.dst = z.src AND z.dst > x.dst AND z.dst > x.src
JOIN adj w ON w.src = z.dst AND w.dst = x.src WHERE x.dst > x.src AND x.dst <> y.dst""")
def match_cycle4(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), "--vertex a b c d --edge x:a:b y:b:c z:c:d w:d:a")


@_query("SELECT sum(n * (n - 1) * (n - 2) * (n - 3))::BIGINT AS matches FROM (SELECT src, count(*) AS n FROM adj JOIN v ON v.id = adj.dst JOIN v c ON c.id = adj.src WHERE v.label = 'cyan' AND c.label = 'white' GROUP BY src)")
def match_star4(spark, sf):
    query = parse("--vertex a b c d e --edge w:a:b x:a:c y:a:d z:a:e --vertexlabel a:white b:cyan c:cyan d:cyan e:cyan")
    return match.count(tables.purchase_succession(spark, sf), query)


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c, z.dst AS v_d FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst JOIN e u ON u.src = x.src AND u.dst = y.dst
JOIN e w ON w.src = x.src AND w.dst = z.dst JOIN e t ON t.src = x.dst AND t.dst = z.dst""")
def match_clique4(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), "--vertex a b c d --edge x:a:b y:b:c z:c:d u:a:c w:a:d t:b:d")


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src
JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst WHERE a.label = 'ASIA' AND b.label = 'EUROPE' AND y.dst <> x.src""", _NATIONS)
def match_directed_triangle(spark, sf):
    return _bindings(tables.nation_trade(spark, sf), TRIANGLE + " --directed --vertexlabel a:ASIA b:EUROPE", False)


@_query("SELECT src AS v_a, dst AS v_b FROM adj WHERE mult > 1")
def match_parallel_edges(spark, sf):
    return _bindings(tables.parallel_successions(spark, sf), "--vertex a b --edge x:a:b y:a:b --edgelabel x:often y:again", False)


_CONDITION = TRIANGLE + " --condition a.score > b.score AND NOT ( c.score == a.score ) AND b.score * 2 >= c.score"


@_query("""SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON z.src = y.dst AND z.dst = x.src
JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst JOIN v c ON c.id = y.dst WHERE a.score > b.score AND c.score <> a.score AND b.score * 2 >= c.score""")
def match_condition(spark, sf):
    return _bindings(tables.purchase_succession(spark, sf), _CONDITION, False)


_ALL_TRIANGLES = "FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON z.src = y.dst AND z.dst = x.src JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst"


@_query(f"SELECT a.label AS label, count(*) AS size {_ALL_TRIANGLES} GROUP BY 1")
def match_groupby(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    return results.grouped(match.exact(graph, parse(TRIANGLE)), graph, ["a.label"]).withColumnRenamed("a.label", "label")


@_query(f"SELECT count(*) AS n, min(a.score)::DOUBLE AS least, max(a.score)::DOUBLE AS most, sum(b.score)::DOUBLE AS total, round(avg(a.score), 6) AS mean {_ALL_TRIANGLES}")
def match_aggregates(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    row = results.aggregated(match.exact(graph, parse(TRIANGLE)), graph, ["COUNT", "MIN:a.score", "MAX:a.score", "SUM:b.score", "AVG:a.score"])
    return row.toDF("n", "least", "most", "total", "mean").withColumn("mean", F.round("mean", 6))


@_query(f"SELECT a.label AS label, count(*) AS n, max(b.score)::DOUBLE AS most {_ALL_TRIANGLES} GROUP BY 1")
def match_grouped_aggregates(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    return results.aggregated(match.exact(graph, parse(TRIANGLE)), graph, ["COUNT", "MAX:b.score"], ["a.label"]).toDF("label", "n", "most")


@_query("SELECT src AS v_a, dst AS v_b, row_number() OVER (ORDER BY src % 10 DESC, dst % 10 DESC, concat(src, ',', dst, '|')) AS place FROM e")
def match_orderby(spark, sf):
    """The order as a column: the ordered rows are numbered by range, not by a window over all of them."""
    graph = tables.purchase_succession(spark, sf)
    found = match.exact(graph, parse("--vertex a b --edge x:a:b"), distinct=True)
    order = results.ordered(found, graph, ["a.score", "b.score"], True).select("v_a", "v_b", F.monotonically_increasing_id().alias("at"))
    return with_rank(order, "at").select("v_a", "v_b", (F.col("rank") + 1).alias("place"))


@_query("""SELECT x.src AS v_a, x.dst AS v_b, 1::BIGINT AS hops FROM adj x JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst WHERE a.label = 'cyan' AND b.label = 'white'
UNION ALL SELECT x.src, y.dst, 2 FROM adj x JOIN adj y ON x.dst = y.src AND y.dst <> x.src JOIN v a ON a.id = x.src JOIN v b ON b.id = y.dst WHERE a.label = 'cyan' AND b.label = 'white'
UNION ALL SELECT x.src, z.dst, 3 FROM adj x JOIN adj y ON x.dst = y.src AND y.dst <> x.src JOIN adj z ON y.dst = z.src AND z.dst <> x.src AND z.dst <> x.dst
JOIN v a ON a.id = x.src JOIN v b ON b.id = z.dst WHERE a.label = 'cyan' AND b.label = 'white'""")
def match_path_edge(spark, sf):
    query = parse("--vertex a b --path p:a:b --vertexlabel a:cyan b:white")
    rows = match.bindings(tables.purchase_succession(spark, sf), query)
    return rows.select("v_a", "v_b", (F.size("p_p") + 1).cast("long").alias("hops"))


@_query("SELECT seed, v_b FROM (SELECT src AS seed, dst AS v_b, row_number() OVER (PARTITION BY src ORDER BY concat(least(src, dst), ',', greatest(src, dst), '|')) AS n FROM adj) WHERE n = 1")
def match_per_seed(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    return match.find(graph, parse("--vertex a b --edge x:a:b"), per_seed=True).select("seed", "v_b")


@_query("SELECT id FROM v WHERE label = 'cyan' AND score = 4")
def seed_filter(spark, sf):
    return tables.purchase_succession(spark, sf).filter_vertices("cyan", {"score": "4"})


@_query("SELECT id, label, score::VARCHAR AS score FROM v")
def vertex_properties(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    return graph.vertex_labels().join(graph.vertex_property("score"), "id")


@_query("SELECT src, dst, CASE WHEN mult > 1 THEN '0=often,1=again' ELSE '0=once' END AS labels FROM e")
def edge_labels(spark, sf):
    found = tables.parallel_successions(spark, sf).edge_labels()
    text = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"])), ",")
    return found.select("src", "dst", text.alias("labels"))


@_query("SELECT src, dst, mult::VARCHAR AS mult FROM e")
def edge_properties(spark, sf):
    return tables.purchase_succession(spark, sf).edge_property("mult").drop("key")


@_query("SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges")
def sizes(spark, sf):
    return metrics.sizes(tables.purchase_succession(spark, sf))


@_query("SELECT src AS id, count(*) AS degree FROM adj GROUP BY 1")
def degrees(spark, sf):
    return metrics.degrees(tables.purchase_succession(spark, sf))


@_query("SELECT degree, count(*) AS vertices FROM (SELECT src, count(*) AS degree FROM adj GROUP BY 1) GROUP BY 1")
def degree_distribution(spark, sf):
    return metrics.degree_distribution(tables.purchase_succession(spark, sf))


@_query("SELECT src AS id, count(*) AS neighbours FROM adj GROUP BY 1 HAVING count(*) >= 4")
def star_centres(spark, sf):
    return metrics.star_centres(tables.purchase_succession(spark, sf))


@_query("SELECT count(*) AS triangles FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")
def triangle_count(spark, sf):
    return metrics.triangle_count(tables.purchase_succession(spark, sf))


_REACH = ", reach(id, component) AS (SELECT id, id FROM v UNION SELECT adj.dst, reach.component FROM reach JOIN adj ON adj.src = reach.id) SELECT id, min(component) AS component FROM reach GROUP BY id"


@_query(_REACH, recursive=True)
def components(spark, sf):
    return metrics.components(tables.purchase_succession(spark, sf))


@_query("SELECT 1.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v) AS density")
def density(spark, sf):
    return metrics.density(tables.purchase_succession(spark, sf))


@_query("SELECT src, dst FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = 'cyan' AND b.label = 'cyan'")
def induced_subgraph(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    return graph.induced(graph.filter_vertices("cyan")).edges.select("src", "dst")


@_query("SELECT src, dst, add FROM e WHERE add < 10")
def time_prefix(spark, sf):
    return tables.purchase_succession(spark, sf).before(10, "cyan").edges.select("src", "dst", "add")


@_query("SELECT count(*) AS edges, (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM e WHERE add = 0 UNION SELECT dst FROM e WHERE add = 0)) AS vertices FROM e WHERE add = 0")
def base_snapshot(spark, sf):
    return metrics.sizes(tables.purchase_succession(spark, sf).base()).select("edges", "vertices")


@_query("SELECT add, count(*) AS edges FROM e GROUP BY 1")
def step_sizes(spark, sf):
    return metrics.steps(tables.purchase_succession(spark, sf))


@_query("SELECT s.add AS step, count(*) AS edges FROM (SELECT DISTINCT add FROM e) s JOIN e ON e.add <= s.add GROUP BY 1")
def snapshot_edges(spark, sf):
    """Edges up to each step: a running sum over the steps, of which there is a row each."""
    per = metrics.steps(tables.purchase_succession(spark, sf))
    return per.select(F.col("add").alias("step"), F.sum("edges").over(Window.orderBy("add")).alias("edges"))


@_query("SELECT id, min(add) AS first_step FROM (SELECT src AS id, add FROM adj) GROUP BY 1")
def first_seen(spark, sf):
    return metrics.first_seen(tables.purchase_succession(spark, sf))


@_query("SELECT greatest(x.add, y.add, z.add) AS add, count(*) AS matches FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst GROUP BY 1")
def delta_triangles(spark, sf):
    return incremental.delta_counts(tables.purchase_succession(spark, sf), parse(TRIANGLE))


@_query(""", last AS (SELECT max(add) AS t FROM e)
SELECT x.src AS v_a, x.dst AS v_b, y.dst AS v_c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst, last WHERE greatest(x.add, y.add, z.add) = t""")
def new_triangles(spark, sf):
    """What the last step's edges complete, found from them."""
    graph = tables.purchase_succession(spark, sf)
    last = graph.edges.agg(F.max("add")).first()[0]
    found = incremental.new_matches(graph.up_to(last - 1), graph.edges.filter(F.col("add") == last), graph, parse(TRIANGLE))
    return results.distinct(found).select(*[F.col("vertices")[i].alias(f"v_{s}") for i, s in enumerate("abc")])


@_query(""", steps AS (SELECT greatest(x.add, y.add, z.add) AS step FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)
SELECT s.add AS step, (SELECT count(*) FROM e WHERE e.add = s.add) AS edges, (SELECT count(*) FROM steps WHERE step = s.add) AS new, (SELECT count(*) FROM steps WHERE step <= s.add) AS total FROM (SELECT DISTINCT add FROM e) s""")
def incremental_replay(spark, sf):
    """Every step from the first, one after the other."""
    graph = tables.purchase_succession(spark, sf)
    for matcher, _ in incremental.replay(graph, parse(TRIANGLE), 0, len(incremental.step_list(graph))):
        pass
    return matcher.report().select("step", "edges", "new", "total")


@_query(""", h0 AS (SELECT id % 4 AS part, id FROM v), h1 AS (SELECT DISTINCT part, dst AS id FROM adj JOIN h0 ON h0.id = src), h2 AS (SELECT DISTINCT part, dst AS id FROM adj JOIN h1 ON h1.id = src)
SELECT part, id, min(d)::BIGINT AS distance FROM (SELECT part, id, 0 AS d FROM h0 UNION ALL SELECT part, id, 1 FROM h1 UNION ALL SELECT part, id, 2 FROM h2) GROUP BY 1, 2""")
def halo(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    members = graph.vertices.select(F.pmod("id", F.lit(4)).alias("part"), "id")
    return partition.halo(graph, members, 2).select("part", "id", F.col("distance").cast("long").alias("distance"))


def _walk_sql(steps: int) -> str:
    ctes = ", w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e), p0 AS (SELECT id AS src, id AS dst, 1.0::DOUBLE AS p FROM v)"
    for i in range(steps):
        ctes += f""", p{i + 1} AS (SELECT src, dst, sum(p) AS p FROM (
  SELECT p.src, w.dst, p.p * w.w * 0.3 AS p FROM p{i} p JOIN w ON w.src = p.dst UNION ALL SELECT id, id, 0.7 FROM v) GROUP BY 1, 2)"""
    return ctes


@_query(_walk_sql(7) + " SELECT src, dst, round(p, 6) AS p FROM p7", _NATIONS)
def random_walk(spark, sf):
    found = walk.random_walk(tables.nation_trade(spark, sf), tolerance=0)
    return found.select("src", "dst", F.round("p", 6).alias("p"))


@_query(_walk_sql(7) + " SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS rank FROM (SELECT src, dst, round(p, 9) AS p FROM p7)", _NATIONS)
def ranked_destinations(spark, sf):
    found = walk.random_walk(tables.nation_trade(spark, sf), tolerance=0)
    return walk.ranked(found.withColumn("p", F.round("p", 9))).select("src", "dst", F.col("rank").cast("long").alias("rank"))


_BEST_PATHS = _walk_sql(7) + """, two AS (SELECT a.src, b.dst, a.dst AS via, row_number() OVER (PARTITION BY a.src, b.dst ORDER BY round(p.p, 9) DESC, a.dst) AS n
FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src JOIN p7 p ON p.src = a.src AND p.dst = a.dst)
SELECT src, dst, NULL::BIGINT AS via, 1::BIGINT AS hops FROM e
UNION ALL SELECT src, dst, via, 2 FROM two WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = two.src AND e.dst = two.dst)"""


@_query(_BEST_PATHS, _NATIONS)
def best_paths(spark, sf):
    graph = tables.nation_trade(spark, sf)
    p = materialise(walk.random_walk(graph, tolerance=0).withColumn("p", F.round("p", 9)), "walk")
    return paths.best_paths(graph, p).withColumn("hops", F.col("hops").cast("long"))


_EXPANSION = _walk_sql(7) + """, good AS (SELECT p.src AS v_a, p.dst AS v_b, ln(p.p + 1e-10) AS g FROM p7 p JOIN v ON v.id = p.dst WHERE p.src <> p.dst AND v.label = 'EUROPE')
SELECT v_a, v_b FROM good QUALIFY g >= max(g) OVER (PARTITION BY v_a) - 1e-5"""


@_query(_EXPANSION, _NATIONS)
def neighbour_expansion(spark, sf):
    graph = tables.nation_trade(spark, sf)
    p = materialise(walk.random_walk(graph, tolerance=0), "walk")
    rows = graph.vertices.select(F.col("id").alias("v_a"))
    return match.expand(rows, "v_a", "v_b", p, graph.filter_vertices("EUROPE"), ["v_a"])


@_query("SELECT id, CASE WHEN first THEN 0 ELSE 1 END::BIGINT AS later FROM (SELECT id, id % 3 = 0 AS first FROM v)")
def known_first(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    known = graph.vertices.filter("id % 3 = 0").select("id", F.col("id").alias("rank"))
    return metrics.added_first(graph.vertices.select("id"), known).select("id", F.col("rank").isNull().cast("long").alias("later"))


@_query("SELECT canon, side FROM (SELECT src || ',' || dst AS canon, 'left' AS side FROM e WHERE add < 10 UNION ALL SELECT src || ',' || dst, 'right' FROM e WHERE add >= 10 AND add < 20)")
def result_difference(spark, sf):
    graph = tables.purchase_succession(spark, sf)
    query = parse("--vertex a b --edge x:a:b")
    early, both = match.exact(graph.before(20), query, distinct=True), match.exact(graph.before(10), query, distinct=True)
    middle = early.join(both, "canon_key", "left_anti")
    return results.difference(both, middle).select(F.substring_index("canon_key", "|", 1).alias("canon"), "side")


def _walked(graph) -> DataFrame:
    """The walk after a fixed number of steps, as _walk_sql() has it."""
    return materialise(walk.random_walk(graph, tolerance=0), "walk")


_CANON = "array_to_string(list_sort(list_distinct({v})), ',') || '|' || array_to_string(list_transform(list_sort({e}), lambda x: x.s || '-' || x.d || '-'), ',')"
_GREEDY = _walk_sql(7) + """,
x AS (SELECT src AS a, dst AS b FROM p7 WHERE src <> dst QUALIFY ln(p + 1e-10) >= max(ln(p + 1e-10)) OVER (PARTITION BY src) - 1e-5),
z AS (SELECT x.a, x.b, p.src AS c FROM x JOIN e ON e.src = a AND e.dst = b JOIN p7 p ON p.dst = a WHERE p.src <> a AND p.src <> b QUALIFY ln(p.p + 1e-10) >= max(ln(p.p + 1e-10)) OVER (PARTITION BY a, b) - 1e-5),
m AS (SELECT a, b, c, """ + _CANON.format(v="[a, b, c]", e="[{'s': a, 'd': b}, {'s': c, 'd': a}, {'s': b, 'd': c}]") + """ AS canon_key FROM z JOIN e q ON q.src = c AND q.dst = a JOIN e r ON r.src = b AND r.dst = c)
SELECT a AS v_a, b AS v_b, c AS v_c, canon_key FROM m QUALIFY row_number() OVER (PARTITION BY canon_key ORDER BY a, b, c) = 1"""


@_query(_GREEDY, _NATIONS)
def greedy_triangles(spark, sf):
    graph = tables.nation_trade(spark, sf)
    found = match.find(graph, parse(TRIANGLE + " --directed"), "greedy", walk=_walked(graph))
    return found.select("v_a", "v_b", "v_c", "canon_key")


_APPROXIMATE = _walk_sql(7) + """, two AS (SELECT a.src, b.dst, a.dst AS via FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src JOIN p7 p ON p.src = a.src AND p.dst = a.dst
  QUALIFY row_number() OVER (PARTITION BY a.src, b.dst ORDER BY p.p DESC, a.dst) = 1),
way AS (SELECT src, dst, [{'s': src, 'd': dst}] AS hops, [src, dst] AS seen FROM e UNION ALL
  SELECT src, dst, [{'s': src, 'd': via}, {'s': via, 'd': dst}], [src, via, dst] FROM two WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = two.src AND e.dst = two.dst)),
x AS (SELECT p.src AS a, p.dst AS b FROM p7 p JOIN v f ON f.id = p.src JOIN v t ON t.id = p.dst WHERE p.src <> p.dst AND f.label = 'ASIA' AND t.label = 'EUROPE'
  QUALIFY ln(p.p + 1e-10) >= max(ln(p.p + 1e-10)) OVER (PARTITION BY p.src) - 1e-5),
xy AS (SELECT a, b, hops, seen FROM x JOIN way ON way.src = a AND way.dst = b),
y AS (SELECT a, b, hops, seen, p.dst AS c FROM xy JOIN p7 p ON p.src = b WHERE NOT list_contains(seen, p.dst) QUALIFY ln(p.p + 1e-10) >= max(ln(p.p + 1e-10)) OVER (PARTITION BY a, b, hops, seen) - 1e-5),
m AS (SELECT a, b, c, y.hops || way.hops AS hops, list_distinct(y.seen || way.seen) AS seen FROM y JOIN way ON way.src = b AND way.dst = c),
k AS (SELECT a, b, c, len(hops) = 2 AND len(seen) = 3 AS exact, """ + _CANON.format(v="seen", e="hops") + """ AS canon_key FROM m)
SELECT a AS v_a, b AS v_b, c AS v_c, exact, canon_key FROM k QUALIFY row_number() OVER (PARTITION BY canon_key ORDER BY a, b, c) = 1"""


@_query(_APPROXIMATE, _NATIONS)
def approximate_matches(spark, sf):
    graph = tables.nation_trade(spark, sf)
    found = match.find(graph, parse("--vertex a b c --edge x:a:b y:b:c --directed --vertexlabel a:ASIA b:EUROPE"), "approx", walk=_walked(graph))
    return found.select("v_a", "v_b", "v_c", "exact", "canon_key")


# In the query's own triangle, a walk from b stands at a after two steps, or five, since it last started over.
@_query(_walk_sql(7) + """, g AS (SELECT a.id, count(p.p) AS n, coalesce(sum(ln(p.p + 1e-10)), 0) AS s FROM v a LEFT JOIN (SELECT p.* FROM p7 p JOIN v b ON b.id = p.src WHERE b.label = 'EUROPE') p ON p.dst = a.id
  WHERE a.label = 'ASIA' GROUP BY a.id),
k AS (SELECT id, (s + ((SELECT count(*) FROM v WHERE label = 'EUROPE') - n) * ln(1e-10)) / (0.7 * 0.3 ** 2 + 0.7 * 0.3 ** 5) AS goodness FROM g)
SELECT id, round(goodness, 6) AS goodness FROM k QUALIFY goodness >= max(goodness) OVER () - 1e-5""", _NATIONS)
def ranked_seeds(spark, sf):
    graph = tables.nation_trade(spark, sf)
    return match.rank_seeds(graph, parse(TRIANGLE + " --directed --vertexlabel a:ASIA b:EUROPE"), _walked(graph)).select("id", F.round("goodness", 6).alias("goodness"))


@_query()
def communities(spark, sf):
    return community.recursive_communities(tables.purchase_succession(spark, sf), 40)


_BLOCKS = ", c AS (SELECT id, id // 40 AS community FROM v), hit AS (SELECT DISTINCT community FROM c WHERE id IN (SELECT src FROM adj WHERE add = 0))"


def _blocks(graph) -> tuple[DataFrame, DataFrame]:
    """Communities that are given (by number), and the ends of the first step's edges."""
    return graph.vertices.select("id", F.floor(F.col("id") / 40).alias("community")), graph.edges.filter("add = 0").select(F.explode(F.array("src", "dst")).alias("id"))


@_query(_BLOCKS + " SELECT id FROM c WHERE community IN (SELECT community FROM hit)")
def affected_vertices(spark, sf):
    return community.affected(*_blocks(tables.purchase_succession(spark, sf)))


@_query(_BLOCKS + " SELECT (SELECT count(*) FROM hit) AS affected, (SELECT count(DISTINCT community) FROM c) AS total")
def affected_communities(spark, sf):
    return community.affected_counts(*_blocks(tables.purchase_succession(spark, sf)))


@_query()
def overlapping_parts(spark, sf):
    members, _ = partition.overlapping_parts(tables.purchase_succession(spark, sf), 4, 1)
    return members.groupBy("part", "distance").agg(F.count("*").alias("vertices"))
