"""Matching against brute force and the sample cases."""

import itertools
import random

import pytest

from thornweave.graph import graph_of
from thornweave.operators import match, results
from thornweave.plans.query import QueryError, parse

# Sample graphs, as vertices and edges.
C6 = [(i, "cyan") for i in range(6)]
MIXED6 = [(i, "cyan" if i % 2 == 0 else "magenta") for i in range(6)]
E1 = [(0, 1), (0, 3), (0, 4), (1, 3), (2, 3), (2, 4), (2, 5), (4, 5)]
SCORES = {0: "1.0", 1: "2.0", 2: "1.0", 3: "2.0", 4: "3.0", 5: "2.0"}
E1P = [(0, 1, "yes"), (0, 3, "yes"), (0, 4, "yes"), (1, 3, "no"), (2, 3, "yes"), (2, 4, "no"), (3, 4, "yes"), (2, 5, "yes"), (4, 5, "yes")]
E4 = [(0, 1, "yes"), (0, 1, "no"), (0, 3, "yes"), (0, 4, "yes"), (1, 3, "yes"), (2, 3, "yes"), (2, 4, "yes"), (2, 5, "yes"), (4, 5, "yes"), (4, 6, "yes"), (5, 6, "yes")]


def yes(edges):
    return [(*e[:2], "yes") for e in edges]


GRAPHS = {
    "test1": (C6, yes(E1), False),
    "test1d": (C6, yes(E1), True),
    "test1p": ([(i, "cyan", {"score": SCORES[i]}) for i in range(6)], E1P, False),
    "test2": (MIXED6, yes(E1), False),
    "test2d": (MIXED6, yes(E1), True),
    "test4": (MIXED6 + [(6, "cyan")], E4, False),
    "line": ([(i, "cyan") for i in range(4)], yes([(0, 1), (1, 2), (2, 3)]), False),
    "test0p": ([(i, "cyan") for i in range(4)], yes([(0, 1), (1, 2), (2, 3), (3, 0)]), False),
}
TRIANGLE = "--vertex a b c --edge x:a:b y:b:c z:c:a"
CASES = [
    ("test1", "--vertex a b c d e --edge x:a:b y:b:c z:c:d w:d:e --vertexlabel a:cyan b:cyan c:cyan d:cyan e:cyan", [set(range(6)) - {i} for i in range(6)], 44),
    ("test1", TRIANGLE + " --vertexlabel a:cyan b:cyan c:cyan", [{0, 1, 3}, {2, 4, 5}], 12),
    ("test1", "--vertex a b c d --edge x:a:b y:b:c z:c:d w:d:a --vertexlabel a:cyan b:cyan c:cyan d:cyan", [{0, 2, 3, 4}], 8),
    ("test2", TRIANGLE + " --vertexlabel a:cyan b:cyan c:magenta", [{2, 4, 5}], 2),
    ("test1p", TRIANGLE, [{0, 1, 3}, {0, 3, 4}, {2, 3, 4}, {2, 4, 5}], 24),
    ("test4", "--vertex a b --edge x:a:b y:a:b --edgelabel x:yes y:no", [{0, 1}], 2),
    ("test1d", "--vertex a b c --edge x:a:b y:a:c z:b:c --directed --vertexlabel a:cyan b:cyan c:cyan", [{0, 1, 3}, {2, 4, 5}], 2),
    ("test2d", "--vertex a b c --edge x:a:b y:a:c z:b:c --directed --vertexlabel a:cyan b:cyan c:magenta", [{2, 4, 5}], 1),
    ("test1p", "--vertex a b c --edge x:a:b y:a:c z:b:c --vertexlabel a:cyan b:cyan c:cyan --edgelabel x:yes y:yes z:yes", [{0, 3, 4}], 6),
    ("line", "--vertex a b --path x:a:b --vertexlabel a:cyan b:cyan --edgelabel x:yes", [{0, 1}, {0, 1, 2}, {0, 1, 2, 3}, {1, 2}, {1, 2, 3}, {2, 3}], 12),
    ("line", "--vertex a b c --path x:a:b --edge y:b:c --vertexlabel a:cyan b:cyan c:cyan --edgelabel x:yes y:yes", [{0, 1, 2}, {0, 1, 2, 3}, {1, 2, 3}], 6),
    ("test0p", "--vertex a b c --edge x:a:b y:b:c --path z:a:c --vertexlabel a:cyan b:cyan c:cyan --edgelabel x:yes y:yes z:yes", [{0, 1, 2, 3}], 8),
    ("test1p", "--vertex a b c --edge x:a:b y:b:c --path z:c:a --vertexlabel a:cyan b:cyan c:cyan --edgelabel x:yes y:yes z:yes", [{0, 3, 4}, {2, 3, 4, 5}, {0, 2, 3, 4, 5}], 24),
]


@pytest.mark.parametrize("name,text,sets,n", CASES)
def test_samples(spark, name, text, sets, n):
    vertices, edges, directed = GRAPHS[name]
    graph, query = graph_of(spark, vertices, edges, directed), parse(text)
    rows = match.exact(graph, query).collect()
    assert {frozenset(r.vertices) for r in rows} == {frozenset(s) for s in sets} and len(rows) == n
    few = match.exact(graph, query, distinct=True).collect()
    assert len({r.canon_key for r in few}) == len(few) and {r.canon_key for r in few} == {r.canon_key for r in rows}
    greedy = match.find(graph, query, "greedy").collect()
    if not query.has_path:
        assert {frozenset(r.vertices) for r in greedy} <= {frozenset(s) for s in sets}
        assert all(r.exact for r in greedy)


def brute(vertices, edges, query, most=3):
    label = {v[0]: v[1] for v in vertices}
    parallel, n_of = {}, {}
    for x in edges:
        pair = (x[0], x[1]) if query.directed else (min(x[:2]), max(x[:2]))
        key = n_of[pair] = n_of.get(pair, -1) + 1
        for a, b in {x[:2]} if query.directed else {x[:2], (x[1], x[0])}:
            parallel.setdefault((a, b), {})[key] = x[2]

    def simple(a, b, el, taken, length):
        if length and b in next_(a, el):
            yield []
        if length > 1:
            for v in next_(a, el):
                if v not in taken and v != b and v != a:
                    for rest in simple(v, b, el, taken | {v}, length - 1):
                        yield [v, *rest]

    def next_(a, el):
        return {b for (x, b), keys in parallel.items() if x == a and b != a and (not el or el in keys.values())}

    out = []
    for chosen in itertools.permutations(label, len(query.vertices)):
        at = dict(zip(query.vertices, chosen, strict=True))
        if any(lab and label[at[s]] != lab for s, lab in query.labels.items()):
            continue
        direct = [e for e in query.edges if not e.path]
        options = [[k for k, el in parallel.get((at[e.src], at[e.dst]), {}).items() if not e.label or el == e.label] for e in direct]
        for keys in itertools.product(*options):
            used = [((at[e.src], at[e.dst]) if query.directed else tuple(sorted((at[e.src], at[e.dst]))), k) for e, k in zip(direct, keys, strict=True)]
            if len(set(used)) < len(used):
                continue
            ways = [[]]
            for e in query.edges:
                if e.path:
                    ways = [w + [p] for w in ways for p in simple(at[e.src], at[e.dst], e.label, set(chosen) | {v for q in w for v in q}, most)]
            out += [(chosen, keys, tuple(map(tuple, w))) for w in ways]
    return sorted(out)


QUERIES = [
    TRIANGLE,
    TRIANGLE + " --vertexlabel a:A",
    "--vertex a b c d --edge x:a:b y:b:c z:c:d w:d:a v:a:c",
    "--vertex a b c d --edge x:a:b y:a:c z:a:d --edgelabel x:p",
    "--vertex a b c --edge x:b:a y:b:c w:b:c",
    "--vertex a b --edge x:a:b y:a:b --edgelabel x:p",
    "--vertex a b --edge x:a:b y:b:a",
    "--vertex a b --edge x:a:b l:a:a",
    "--vertex a b c --edge x:a:b --path p:b:c",
    "--vertex a b c --path p:c:a q:a:b --vertexlabel b:B --edgelabel p:q",
]


@pytest.mark.parametrize("text", QUERIES)
@pytest.mark.parametrize("directed", [False, True])
def test_against_brute_force(spark, text, directed):
    rng = random.Random(len(text))
    vertices = [(i, rng.choice("AB")) for i in range(7)]
    edges = [(rng.randrange(7), rng.randrange(7), rng.choice("pq")) for _ in range(14)]
    query = parse(text + " --directed" * directed)
    graph = graph_of(spark, vertices, edges, directed, True)
    rows = match.bindings(graph, query).collect()
    got = sorted((tuple(r[f"v_{s}"] for s in query.vertices), tuple(r[f"k_{e.name}"] for e in query.edges if not e.path), tuple(tuple(r[f"p_{e.name}"]) for e in query.edges if e.path)) for r in rows)
    assert got == brute(vertices, edges, query)
    keys = {r.canon_key for r in match.exact(graph, query).collect()}
    few = [r.canon_key for r in match.exact(graph, query, distinct=True).collect()]
    assert sorted(few) == sorted(keys)


def test_results(spark):
    vertices, edges, _ = GRAPHS["test1p"]
    graph, query = graph_of(spark, vertices, edges), parse(TRIANGLE)
    found = match.exact(graph, query)
    row = results.aggregated(found, graph, ["COUNT", "MAX:a.score", "MIN:a.score", "SUM:a.score", "AVG:a.score"]).first()
    assert tuple(row)[:3] == (24, 3.0, 1.0) and row[3] == pytest.approx(row[4] * 24)
    groups = {r["a.score"]: r["size"] for r in results.grouped(found, graph, ["a.score"]).collect()}
    assert sum(groups.values()) == 24 and set(groups) == {"1.0", "2.0", "3.0"}
    both = results.aggregated(found, graph, ["COUNT"], ["a.score"]).collect()
    assert {r["a.score"]: r["COUNT"] for r in both} == groups
    order = [r["a.score"] for r in results.ordered(found, graph, ["a.score"], True).collect()]
    assert order == sorted(order, reverse=True)
    none = results.aggregated(found.limit(0), graph, ["COUNT", "MAX:a.score"]).first()
    assert tuple(none) == (None, None)
    assert len({r.seed for r in match.find(graph, query, per_seed=True).collect()}) == match.find(graph, query, per_seed=True).count() == 6
    with pytest.raises(results.ResultError):
        results.parse_aggregate("MEDIAN:a.score")
    assert results.difference(found, found.limit(0)).count() == 4


def test_condition_in_a_match(spark):
    vertices, edges, _ = GRAPHS["test1p"]
    graph = graph_of(spark, vertices, edges)
    scores = {k: float(v) for k, v in SCORES.items()}
    rows = match.exact(graph, parse(TRIANGLE + ' --condition "a.score > b.score AND NOT c.score == 1"')).collect()
    every = match.exact(graph, parse(TRIANGLE)).collect()
    want = sorted((r.v_a, r.v_b, r.v_c) for r in every if scores[r.v_a] > scores[r.v_b] and scores[r.v_c] != 1)
    assert sorted((r.v_a, r.v_b, r.v_c) for r in rows) == want and want


@pytest.mark.parametrize("text", ["--vertex a b", "--vertex a b c --edge x:a:b", "--edge x:a:b", "--vertex a a --edge x:a:a", "--vertex a b --edge x:a:c", "--vertex a b --edge x:a", "--vertex a b --edge x:a:b --vertexlabel c:L", "--vertex a b --edge x:a:b x:b:a", "--vertex a b --edge x:a:b --nothing 1", "a b"])
def test_what_is_no_query(text):
    with pytest.raises(QueryError):
        parse(text)


def test_query_text():
    q = parse("--vertex a b --path p:a:b --edgelabel p:x:y --condition a.x > 1 AND b.y == 2 --groupby a.x --orderby b.y --desc --aggregate COUNT MAX:a.x --graph g")
    assert q.edges[0].label == "x:y" and q.edges[0].path and q.condition == "a.x > 1 AND b.y == 2" and q.descending and q.aggregates == ("COUNT", "MAX:a.x")


def test_approximate_matches(spark):
    """A best path of two edges stands in for an edge that isn't there."""
    graph = graph_of(spark, [(i, "L") for i in range(4)], [(0, 1), (1, 2), (2, 3), (3, 0)])
    query = parse(TRIANGLE)
    found = match.find(graph, query, "approx").collect()
    assert found and not any(r.exact for r in found) and all(len(r.edges) == 4 for r in found)
    assert match.find(graph, query, "greedy").collect() == [] == match.find(graph, query).collect()


def test_seed_ranking(spark):
    from thornweave.operators.walk import random_walk

    vertices, edges, _ = GRAPHS["test1"]
    graph = graph_of(spark, vertices, edges)
    rows = match.rank_seeds(graph, parse(TRIANGLE), random_walk(graph)).collect()
    assert rows and {r.id for r in rows} <= set(range(6))


@pytest.mark.parametrize("labels,complete", [("a:A b:B c:C", True), ("a:A b:A c:B", True), ("a:A b:B", False), ("", True), ("a:A", False)])
def test_labels_that_rule_out_symmetries(labels, complete):
    from thornweave.plans.planner import symmetry_breaks

    assert symmetry_breaks(parse(TRIANGLE + (" --vertexlabel " + labels if labels else "")))[2] == complete


def test_one_defined_match_for_each_subgraph(spark):
    vertices, edges, _ = GRAPHS["test1p"]
    graph = graph_of(spark, vertices, edges)
    found = match.exact(graph, parse(TRIANGLE))
    first = {}
    for r in sorted(found.collect(), key=lambda r: (r.v_a, r.v_b, r.v_c)):
        first.setdefault(r.canon_key, (r.v_a, r.v_b, r.v_c))
    for df in (found, found.repartition(7)):
        assert {r.canon_key: (r.v_a, r.v_b, r.v_c) for r in results.distinct(df).collect()} == first


def test_rare_labels_first(spark):
    vertices, edges, _ = GRAPHS["test4"]
    graph, query = graph_of(spark, vertices, edges), parse("--vertex a b c --edge x:a:b y:a:c --vertexlabel b:cyan c:magenta")
    plain = match.bindings(graph, query).collect()
    assert graph.label_counts() == {"cyan": 4, "magenta": 3} and sorted(map(str, match.bindings(graph, query, selectivity=graph.label_counts()).select(plain[0].__fields__).collect())) == sorted(map(str, plain))
