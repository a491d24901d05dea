"""Files, generators and configuration."""

import json
from collections import Counter

import pytest

from thornweave.graph import graph_of
from thornweave.sources import files, generators
from thornweave.sources.config import parse_config

DOC = {
    "directed": False,
    "multigraph": True,
    "graph": {},
    "nodes": [{"id": 0, "label": "cyan", "score": 1.5}, {"id": 1, "label": "magenta", "score": "2"}, {"id": 2}],
    "links": [{"source": 0, "target": 1, "label": "yes", "add": 0}, {"source": 1, "target": 0, "label": "no", "add": 1.0, "w": 3}, {"source": 1, "target": 2, "key": 4}],
}


def test_node_link(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(DOC, indent=2))
    graph = files.read_node_link(spark, str(path))
    assert not graph.directed and graph.multi
    assert sorted((r.id, r.label, r.props) for r in graph.vertices.collect()) == [(0, "cyan", {"score": "1.5"}), (1, "magenta", {"score": "2"}), (2, "", {})]
    edges = sorted((r.src, r.dst, r.key, r.label, r["add"], tuple(r.props.items())) for r in graph.edges.fillna(-1).collect())
    assert edges == [(0, 1, 0, "yes", 0, ()), (1, 0, 1, "no", 1, (("w", "3"),)), (1, 2, 4, "", -1, ())]
    files.write_node_link(graph, str(tmp_path / "out"))
    again = files.read_node_link(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, graph.edges.collect()))
    assert sorted(map(str, again.vertices.collect())) == sorted(map(str, graph.vertices.collect()))
    text = json.loads(files.node_link(graph).first().value)
    assert text["multigraph"] is True and text["links"][0]["source"] == 0


def test_edge_lists(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text("1 2\n2 3\n3 1\n2 1\n4 5\n")
    graph = files.read_edge_list(spark, str(path), 2)
    assert {(r.src, r.dst): r["add"] for r in graph.edges.collect()} == {(1, 2): 1, (2, 3): 0, (1, 3): 1, (4, 5): 2}
    assert {(r.id, r.label) for r in graph.vertices.collect()} == {(i, "cyan") for i in range(1, 6)} and graph.edges.first().label == "yes"
    day = 86400
    path.write_text(f"1 2 {10 * day + 5}\n2 3 {11 * day}\n1 2 {12 * day}\n7 8 {14 * day}\n3 4 {11 * day}\n")
    assert {(r.src, r.dst): r["add"] for r in files.read_timed_edge_list(spark, str(path)).edges.collect()} == {(1, 2): 2, (2, 3): 1, (7, 8): 4, (3, 4): 1}
    assert {(r.src, r.dst): r["add"] for r in files.read_timed_edge_list(spark, str(path), 3).edges.collect()} == {(1, 2): 2, (2, 3): 1}
    stamped = files.read_timestamped(spark, str(path))
    assert sorted((r.src, r.dst, r.key, r["add"]) for r in stamped.edges.collect()) == [(1, 2, 0, 0), (1, 2, 1, 2), (2, 3, 0, 1), (3, 4, 0, 1), (7, 8, 0, 4)]
    files.write_edge_list(stamped, str(tmp_path / "plain"))
    assert spark.read.text(str(tmp_path / "plain")).count() == 5
    path.write_text("'\"2004-05-06 07:08:09\"',\"1\",\"2\"\n\"2004-05-05 23:59:59\",2,3\"\n")
    assert sorted((r.src, r.dst, r["add"]) for r in files.read_timestamp_csv(spark, str(path)).edges.collect()) == [(1, 2, 1), (2, 3, 0)]


def test_order_of_files(spark, tmp_path):
    """A folder's files come in the order of their names, whatever their sizes, and a file's splits in their order in it."""
    day = 86400
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"1 2 {1 * day}\n2 3 {2 * day}\n")
    (tmp_path / "in" / "b.txt").write_text("".join(f"{i} {i + 1} {10 * day}\n" for i in range(100, 400)))
    steps = {r["add"] for r in files.read_timed_edge_list(spark, str(tmp_path / "in")).edges.collect()}
    assert steps == {0, 1, 9}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        lines = files.read_edge_list(spark, str(tmp_path / "in"), 1).edges.filter("src >= 100").orderBy("src").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(lines) == 300 and [r["add"] for r in lines] == list(range(2, 302))


def test_shared_folder(spark):
    """Without a named folder, only one process may use its own disk."""
    from types import SimpleNamespace

    from thornweave import storage

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    assert storage.shared_folder(session("local[4]")).startswith("file:///") and storage.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            storage.shared_folder(session(master))


def test_state(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, p double")
    files.write_state(df, str(tmp_path), "walk", 3)
    assert files.read_state(spark, str(tmp_path), "walk", 3).collect() == df.collect()


@pytest.mark.parametrize("make", [generators.preferential_attachment, generators.clustered_attachment])
def test_attachment(make):
    edges = make(60, 3, seed=1)
    assert len(edges) == 57 * 3 and make(60, 3, seed=1) == edges != make(60, 3, seed=2)
    pairs = {frozenset(e) for e in edges}
    assert len(pairs) == len(edges) and all(len(p) == 2 for p in pairs) and Counter(a for a, _ in edges) == {v: 3 for v in range(3, 60)}


def test_triangles_come_with_clustering():
    def closed(edges):
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        return sum(len(near[a] & near[b]) for a, b in edges)

    assert closed(generators.clustered_attachment(400, 3, 0.9, 1)) > 1.5 * closed(generators.clustered_attachment(400, 3, 0.0, 1))


@pytest.mark.parametrize("n,d", [(10, 3), (50, 4), (8, 0), (6, 5)])
def test_regular(n, d):
    edges = generators.random_regular(n, d, 3)
    degree = Counter(v for e in edges for v in e)
    assert len({frozenset(e) for e in edges}) == len(edges) == n * d // 2 and all(degree[v] == d for v in range(n))


def test_generated_graph(spark):
    edges = generators.random_regular(20, 4)
    graph = generators.as_graph(spark, edges, 10)
    assert Counter(r["add"] for r in graph.edges.collect()) == {0: 10, 1: 10, 2: 10, 3: 10}
    assert [(r.src, r.dst) for r in generators.as_frame(spark, edges).orderBy("at").collect()] == edges
    for bad in (lambda: generators.random_regular(5, 3), lambda: generators.preferential_attachment(3, 3)):
        with pytest.raises(ValueError):
            bad()


def test_config():
    c = parse_config("[Log]\nprofile = False\nlevel = debug\n[Run]\ninput_json = g.json\nbase_steps = 5\nsteps = 2\nquery = --vertex a b --edge x:a:b\ntime_limit = 1.5\nnum_proc = 3\n")
    assert (c.input_json, c.base_steps, c.steps, c.time_limit, c.num_proc, c.level, c.profile) == ("g.json", 5, 2, 1.5, 3, "debug", False) and c.query.startswith("--vertex")


def test_loops_and_empty_graphs(spark):
    graph = graph_of(spark, [], [])
    assert json.loads(files.node_link(graph).first().value) == {"directed": False, "multigraph": False, "graph": {}, "nodes": [], "links": []}
