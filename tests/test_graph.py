"""Graphs, walks, paths, counts, communities and parts against plain Python."""

import random
from collections import Counter

import pytest
from test_components import brute as brute_components

from thornweave.graph import graph_of
from thornweave.operators import community, metrics, partition, paths, walk
from thornweave.operators.ranking import with_rank


def made(spark, seed, n=25, m=60, directed=False):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice("pq"), rng.randrange(5)) for _ in range(m)]
    vertices = [(i, "AB"[i % 2], {"score": str(i % 3)}) for i in range(n + 2)]
    return vertices, edges, graph_of(spark, vertices, edges, directed, True)


def ways(edges, directed, label=""):
    out = Counter()
    for a, b, el, _ in edges:
        if not label or el == label:
            out[a, b] += 1
            if not directed and a != b:
                out[b, a] += 1
    return out


def brute_walk(vertices, edges, directed, tolerance=1e-3):
    moves, total = ways(edges, directed), Counter()
    for (a, _), n in moves.items():
        total[a] += n
    out = {}
    for s, *_ in vertices:
        p, change, steps = {s: 1.0}, 1.0, 0
        while change > tolerance:
            new = Counter({s: 0.7})
            for (a, b), n in moves.items():
                if a in p:
                    new[b] += 0.3 * p[a] * n / total[a]
            change = sum(abs(new[v] - p.get(v, 0.0)) for v in {*new, *p})
            p, steps = dict(new), steps + 1
        assert steps <= walk.MOST_STEPS
        out |= {(s, v): x for v, x in p.items()}
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_walk_and_paths(spark, directed):
    vertices, edges, graph = made(spark, 3, directed=directed)
    found = walk.random_walk(graph)
    want = brute_walk(vertices, edges, directed)
    got = {(r.src, r.dst): r.p for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(got[s, s] >= 0.7 - 1e-12 for s, *_ in vertices)
    for label in ("", "p"):
        moves = {k for k in ways(edges, directed, label) if k[0] != k[1]}
        best = {}
        for a, u in moves:
            for u2, b in moves:
                if u == u2 and b != a and (a, b) not in moves:
                    best[a, b] = min(best.get((a, b), (9, 0)), (-round(want[a, u], 12), u))
        rows = {(r.src, r.dst): (r.via, r.hops) for r in paths.best_paths(graph, found, label).collect()}
        assert {k: v for k, v in rows.items() if v[1] == 1} == {k: (None, 1) for k in moves}
        long = {k: v[0] for k, v in rows.items() if v[1] == 2}
        assert long.keys() == best.keys() and all(abs(want[a, v] + best[a, b][0]) < 1e-9 for (a, b), v in long.items())


def test_partial_walks(spark):
    vertices, edges, graph = made(spark, 4)
    old = walk.random_walk(graph)
    sources = graph.vertices.filter("id < 4").select("id")
    part = walk.random_walk(graph, sources)
    assert {r.src for r in part.collect()} == {0, 1, 2, 3}
    same = {(r.src, r.dst): round(r.p, 9) for r in walk.update(old, graph, sources).collect()}
    assert same == {(r.src, r.dst): round(r.p, 9) for r in old.collect()}
    pairs = spark.createDataFrame([(0, 0), (0, 26)], "src long, dst long")
    assert {r.dst: r.p > 0 for r in walk.value(old, pairs).collect()} == {0: True, 26: False}
    fixed = walk.random_walk(graph, tolerance=0, steps=2).groupBy("src").agg({"p": "sum"}).collect()
    assert all(r[1] <= 1 + 1e-9 for r in fixed)


def test_counts(spark):
    vertices, edges, graph = made(spark, 5)
    near = {}
    for a, b in ways(edges, False):
        if a != b:
            near.setdefault(a, set()).add(b)
    ids = [v[0] for v in vertices]
    triangles = sorted((a, b, c) for a in ids for b in ids for c in ids if a < b < c and b in near.get(a, ()) and c in near.get(a, ()) and c in near.get(b, ()))
    assert sorted(tuple(r) for r in metrics.triangles(graph).collect()) == triangles and triangles
    degree = Counter(x for e in edges for x in e[:2])
    assert {r.id: r.degree for r in metrics.degrees(graph).collect()} == {i: degree[i] for i in ids}
    assert {r.degree: r.vertices for r in metrics.degree_distribution(graph).collect()} == Counter(degree[i] for i in ids)
    assert {r.id for r in metrics.star_centres(graph, 4).collect()} == {i for i in near if len(near[i]) >= 4}
    comp = {**{i: i for i in ids}, **brute_components([e[:2] for e in edges])}
    assert {r.id: r.component for r in metrics.components(graph).collect()} == comp
    sizes = sorted((n for n in Counter(comp.values()).values()), reverse=True)
    assert [r["size"] for r in metrics.component_sizes(graph).collect()] == sizes
    assert metrics.component_size_summary(graph).first().largest_size == sizes[0]
    assert metrics.density(graph).first().density == len(edges) / len(ids)
    assert {r.add: r.edges for r in metrics.steps(graph).collect()} == Counter(e[3] for e in edges)
    first = {}
    for a, b, _, t in edges:
        for x in (a, b):
            first[x] = min(first.get(x, t), t)
    assert {r.id: r.first_step for r in metrics.first_seen(graph).collect()} == first


def test_lookups_and_parts(spark):
    vertices, edges, graph = made(spark, 6)
    assert {r.id for r in graph.filter_vertices("A", {"score": "1"}).collect()} == {i for i, lab, p in vertices if lab == "A" and p["score"] == "1"}
    few = spark.createDataFrame([(1,), (2,), (3,), (99,)], "id long")
    assert {r.id for r in graph.filter_vertices("A", None, few).collect()} == {2}
    assert {r.id: r.nothing for r in graph.vertex_property("nothing").collect()} == {v[0]: "" for v in vertices}
    labels = {}
    for a, b, el, _ in edges:
        labels.setdefault((min(a, b), max(a, b)), []).append(el)
    assert {(r.src, r.dst): list(dict(sorted(r.labels.items())).values()) for r in graph.edge_labels().collect()} == labels
    pairs = graph.pairs().select("src", "dst").distinct()
    assert graph.with_edge_label(pairs, "p").count() == sum("p" in v for v in labels.values()) and graph.with_edge_label(pairs, "").count() == len(labels)
    inside = graph.induced(few)
    assert {(r.src, r.dst) for r in inside.edges.collect()} == {e[:2] for e in edges if {*e[:2]} <= {1, 2, 3}} and inside.vertices.count() == 3
    assert graph.up_to(2).edges.count() == sum(e[3] <= 2 for e in edges) and graph.base().edges.count() == sum(e[3] == 0 for e in edges)
    more = graph.plus(graph.edges.limit(5).union(spark.createDataFrame([(500, 501, 0, "p", 9, {})], graph.edges.schema)))
    assert more.edges.count() == len(edges) + 1 and more.vertices.count() == len(vertices) + 2
    assert {r.id: r.label for r in graph.attach(few).collect()} == {1: "B", 2: "A", 3: "B", 99: ""}


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = with_rank(spark.createDataFrame(rows, "a long, b long").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and sorted(r["rank"] for r in got) == list(range(500))


def test_communities(spark):
    """Cliques that are joined by single edges come apart."""
    cliques = [(10 * c + i, 10 * c + j) for c in range(4) for i in range(6) for j in range(i)]
    edges = cliques + [(10 * c, 10 * (c + 1) + 1) for c in range(3)]
    graph = graph_of(spark, [(10 * c + i, "L") for c in range(4) for i in range(6)] + [(99, "L")], edges)
    found = community.recursive_communities(graph, 8)
    got = {r.id: r.community for r in found.collect()}
    assert got == {**{10 * c + i: 10 * c for c in range(4) for i in range(6)}, 99: 99}
    assert community.modularity(graph, found) > 0.6
    hit = spark.createDataFrame([(3,), (99,), (1000,)], "id long")
    assert {r.id for r in community.affected(found, hit).collect()} == {0, 1, 2, 3, 4, 5, 99, 1000}
    assert tuple(community.affected_counts(found, hit).first()) == (2, 5)


def test_parts(spark):
    vertices, edges, graph = made(spark, 8, 40, 70)
    members = partition.balanced_parts(graph, 4)
    part = {r.id: r.part for r in members.collect()}
    sizes = Counter(part.values())
    assert part.keys() == {v[0] for v in vertices} and set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    near = {}
    for a, b in ways(edges, False):
        near.setdefault(a, set()).add(b)
    for depth in (1, 2):
        want = {}
        for p in range(4):
            seen = {i: 0 for i in part if part[i] == p}
            for d in range(1, depth + 1):
                for i in [i for i, x in seen.items() if x == d - 1]:
                    for j in near.get(i, ()):
                        seen.setdefault(j, d)
            want |= {(p, i): d for i, d in seen.items()}
        assert {(r.part, r.id): r.distance for r in partition.halo(graph, members, depth).collect()} == want
    both, inside = partition.overlapping_parts(graph, 3, 1)
    of = {}
    for r in both.collect():
        of.setdefault(r.part, set()).add(r.id)
    assert Counter(r.part for r in inside.collect()) == Counter(p for p, ids in of.items() for e in edges if {*e[:2]} <= ids)
    chunks = Counter(r.chunk for r in partition.seed_chunks(graph.vertices, 5).collect())
    assert max(chunks.values()) - min(chunks.values()) <= 1
    load = Counter()
    for r in partition.component_chunks(graph, 2).collect():
        load[r.chunk] += r["size"]
    assert sum(load.values()) == len(vertices)
