"""Steps, streams and the controller."""

import random

import numpy as np
import pytest
from test_match import CASES, GRAPHS

from thornweave import cli
from thornweave.graph import graph_of
from thornweave.operators import match
from thornweave.plans.query import parse
from thornweave.sources import files
from thornweave.sources.config import EngineConfig, parse_config
from thornweave.streaming import adaptive, incremental

TRIANGLE = "--vertex a b c --edge x:a:b y:b:c z:c:a"


def made(spark, seed=1, n=12, m=36):
    rng = random.Random(seed)
    pairs = list({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    rng.shuffle(pairs)
    return graph_of(spark, [(i, "AB"[i % 2]) for i in range(n)], [(*p, rng.choice("pq"), i // 8) for i, p in enumerate(pairs)])


def keys(df):
    return sorted(r.canon_key for r in df.select("canon_key").distinct().collect())


@pytest.mark.parametrize("text", [TRIANGLE + " --vertexlabel a:A", "--vertex a b c --edge x:a:b --path p:b:c --edgelabel p:q"])
def test_steps_give_what_snapshots_give(spark, text):
    graph, query = made(spark), parse(text)
    for matcher, m in incremental.replay(graph, query, 2, 2):
        now = graph.up_to(1 if m is None else m.step)
        assert keys(matcher.matches) == keys(match.exact(now, query, distinct=True))
        assert matcher.matches.count() == len(keys(matcher.matches))
    again = matcher.step(graph.edges.filter("add = 3"), 3)
    assert again.edges == 0 and again.new == 0
    assert matcher.report().count() == 3 and matcher.metrics[0].throughput >= 0


def test_merged_steps(spark, monkeypatch, tmp_path):
    """Tables of every two steps are merged, and of every four; a resumed matcher reads the same."""
    monkeypatch.setattr(incremental, "FAN", 2)
    graph, query, state = made(spark, 6, 8, 60), parse(TRIANGLE), f"file://{tmp_path}/state"
    steps = incremental.step_list(graph)
    matcher = incremental.IncrementalMatcher(graph.up_to(-1), query, state=state)
    for i, e in enumerate(graph.edges.orderBy("src", "dst").limit(5).collect()):
        now = graph.edges.filter(f"src = {e.src} AND dst = {e.dst}")
        matcher.step(now, i, graph.vertices)
        again = incremental.IncrementalMatcher.resume(spark, query, state)
        assert matcher.graph.edges.count() == i + 1 == again.graph.edges.count()
        assert keys(matcher.matches) == keys(match.exact(matcher.graph, query, distinct=True)) == keys(again.matches)
    assert len(steps) > 1 and [p.rsplit("/", 1)[1] for p in matcher._blocks("edges", 0, 5, 5)] == ["merged=1-4", "seq=5"]
    assert matcher.step(graph.edges, 5, graph.vertices).edges == graph.edges.count() - 5
    assert keys(matcher.matches) == keys(match.exact(graph, query, distinct=True)) and matcher.matches.count() == len(keys(matcher.matches))
    assert matcher.new_of(5).count() == matcher.metrics[-1].new and sorted(r.id for r in matcher.graph.vertices.collect()) == sorted({x for r in graph.edges.collect() for x in (r.src, r.dst)})


def test_new_matches_are_found_once(spark):
    graph, query = made(spark, 4), parse(TRIANGLE)
    new = incremental.new_matches(graph.up_to(2), graph.edges.filter("add = 3"), graph.up_to(3), query).collect()
    every = {(r.v_a, r.v_b, r.v_c) for r in match.exact(graph.up_to(3), query).collect()}
    old = {(r.v_a, r.v_b, r.v_c) for r in match.exact(graph.up_to(2), query).collect()}
    assert sorted((r.v_a, r.v_b, r.v_c) for r in new) == sorted(every - old) and new
    counts = {r["add"]: r.matches for r in incremental.delta_counts(graph, query).collect()}
    assert counts[3] == len(every - old) // 6


def test_guided_steps(spark):
    graph, query = made(spark, 2), parse(TRIANGLE)
    matcher = None
    for matcher, m in incremental.replay(graph, query, 3, 1, mode="guided", community_size=4, approximate=True):
        pass
    assert m.recomputed >= 1 and set(keys(matcher.matches.filter("exact"))) <= {k.replace("-0", "-") for k in keys(match.exact(graph.up_to(m.step), query))}


def test_batch_replay_and_time_limit(spark):
    graph, query = made(spark), parse(TRIANGLE)
    seen = [(s, found.count()) for s, found, _ in incremental.replay_batch(graph, query, 2, 1)]
    assert [s for s, _ in seen] == [1, 2] and seen[0][1] <= seen[1][1]
    plain = graph_of(spark, [(i, "L") for i in range(3)], [(0, 1), (1, 2), (0, 2)])
    assert [(s, f.count()) for s, f, _ in incremental.replay_batch(plain, query, 1, 1)] == [(None, 1)]
    ticks = iter(range(100))
    some, done = incremental.anytime(graph, query, 1.0, 4, clock=lambda: next(ticks))
    every, all_ = incremental.anytime(graph, query, 0, 4)
    assert done == 1 and all_ == 4 and set(keys(some)) <= set(keys(every)) and keys(every) == keys(match.exact(graph, query, distinct=True))
    known = graph.vertices.filter("id > 8").selectExpr("id", "id as rank")
    first, done = incremental.anytime(graph, query, 1.0, 2, known, clock=lambda: next(ticks))
    assert done == 1 and {r.seed for r in first.collect()} <= {9, 10, 11}
    ranks = {r.id: r["rank"] for r in incremental.update_known(known, graph.vertices).collect()}
    assert ranks[9] == 9 and sorted(ranks) == list(range(12)) and min(ranks[i] for i in range(9)) > 11


def test_stream(spark, tmp_path):
    graph, query = made(spark), parse(TRIANGLE)
    for s in (2, 3):
        graph.edges.filter(f"add = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    matcher = incremental.IncrementalMatcher(graph.up_to(1), query)
    q = incremental.stream(incremental.edge_stream(spark, str(tmp_path / "in")), matcher, str(tmp_path / "out"), f"file://{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert keys(matcher.matches) == keys(match.exact(graph.up_to(3), query, distinct=True)) and len(matcher.metrics) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(m.new for m in matcher.metrics)
    timed = spark.createDataFrame([(1, 2, "2020-01-02 03:00:00"), (1, 3, "2020-01-03 01:00:00")], "src long, dst long, at string").selectExpr("src", "dst", "timestamp(at) AS at")
    rows = incremental.stepped(timed, "at", "1 hour").orderBy("dst").collect()
    assert rows[1]["add"] - rows[0]["add"] == 1


class Line:
    """Pays for a threshold near 5."""

    def __init__(self):
        self.x, self.n = 1, 0

    def observation(self):
        return np.array([self.x / 10, 0.0])

    def step(self, action):
        self.x += {0: -1, 1: 1, 2: 0}[action] * (0 < self.x + {0: -1, 1: 1, 2: 0}[action] < 11)
        self.n += 1
        return self.observation(), 10 - abs(self.x - 5), self.n % 50 == 0, {"x": self.x}


def test_learner():
    assert adaptive.reward(0.5) == 100 and adaptive.reward(4) == 25 and adaptive.reward(0) == 100
    learner = adaptive.QLearner(seed=1)
    first = adaptive.episode(Line(), learner, 50)
    losses = [e["loss"] for e in first]
    assert len(first) == 50 and all(np.isfinite(losses)) and len(learner.replay) == 20
    assert adaptive.QLearner(seed=1).values(np.zeros(10)).shape == (3,)
    rng, values = random.Random(0), np.array([0.0, 3.0, 1.0])
    assert adaptive.greedy(values, rng) == 1
    assert {adaptive.epsilon_greedy(values, rng, 0.9) for _ in range(50)} == {0, 1, 2} and {adaptive.boltzmann(values, rng) for _ in range(80)} == {0, 1, 2}
    with pytest.raises(ValueError):
        adaptive.QLearner(policy="none")
    small = adaptive.QLearner(seed=2)  # gradients against differences
    small.replay.clear()
    s = np.linspace(-1, 1, 10)
    before = small.values(s)[1]
    for _ in range(60):
        small.learn(s, 1, 5.0, s, True)
    assert abs(small.values(s)[1] - 5) < abs(before - 5)


def test_environment(spark):
    env = adaptive.MatchingEnvironment(made(spark), parse(TRIANGLE), 2, 2, clock=iter(range(0, 1000, 4)).__next__)
    start = env.threshold
    assert env.observation().shape == (2,) and env.observation()[0] > 0
    observation, gain, last, info = env.step(adaptive.LARGER)
    assert gain == 25 and not last and info["threshold"] == min(start + 1, env.most) == env.matcher.community_size and 0 <= observation[1] <= 1
    env.move(adaptive.SMALLER)
    env.move(adaptive.HOLD)
    assert env.threshold == max(1, info["threshold"] - 1)
    assert env.step(adaptive.HOLD)[2]
    env.rewind()
    assert env.count == 0 and env.seed(3) == [3]
    assert env.render().startswith(f"step 0 of 2, threshold {env.threshold} of {env.most}, ") and "new patterns" in env.render()
    env.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        env.matcher.matches.count()


def test_command_line(spark, tmp_path):
    graph = made(spark)
    files.write_node_link(graph, str(tmp_path / "g"))
    config = EngineConfig(str(tmp_path / "g"), TRIANGLE + " --orderby a.label --desc", 2, 2)
    rows = cli.run(spark, config).collect()
    query = parse(TRIANGLE)
    assert sorted({r.canon_key for r in rows}) == keys(match.exact(graph.up_to(3), query, distinct=True))
    assert cli.run(spark, config, batch=True).count() == len(rows)
    assert cli.run_query(graph, TRIANGLE + " --aggregate COUNT").first()[0] == match.count(graph, query).first()[0]


GOLDEN = [c for c in CASES if c[0] in ("test1", "test1p", "test4", "test1d", "line")]


@pytest.mark.parametrize("name,text,sets,n", GOLDEN)
def test_samples_through_a_configuration(spark, tmp_path, name, text, sets, n):
    """A replay in steps gives what the query gives on the whole graph: subgraphs, and all bindings where they are counted."""
    vertices, edges, directed = GRAPHS[name]
    graph = graph_of(spark, vertices, [(*e, i // 4) for i, e in enumerate(edges)], directed, name == "test4")
    files.write_node_link(graph, str(tmp_path / "g"))
    ini = f"[Log]\nlevel = info\n[Run]\ninput_json = {tmp_path / 'g'}\nbase_steps = 1\nsteps = 9\nquery = {text}"
    rows = cli.run(spark, parse_config(ini)).collect()
    assert {frozenset(r.vertices) for r in rows} == {frozenset(s) for s in sets} and len({r.canon_key for r in rows}) == len(rows)
    for batch in (False, True):
        assert cli.run(spark, parse_config(ini + " --aggregate COUNT"), batch=batch).first()[0] == n


def test_aggregates_through_a_configuration(spark, tmp_path):
    vertices, edges, _ = GRAPHS["test1p"]
    graph = graph_of(spark, vertices, [(*e, i // 3) for i, e in enumerate(edges)])
    files.write_node_link(graph, str(tmp_path / "g"))
    for more in ("--aggregate COUNT MAX:a.score MIN:b.score SUM:a.score AVG:c.score", "--groupby a.score", "--groupby a.score --aggregate COUNT MAX:b.score"):
        text = TRIANGLE + " " + more
        config = EngineConfig(str(tmp_path / "g"), text, 1, 9)
        assert sorted(map(tuple, cli.run(spark, config).collect())) == sorted(map(tuple, cli.run_query(graph, text).collect()))
    order = TRIANGLE + " --orderby a.score b.score --desc"
    got, want = cli.run(spark, EngineConfig(str(tmp_path / "g"), order, 1, 9)), cli.run_query(graph, order)
    assert [r.canon_key for r in got.collect()] == [r.canon_key for r in want.collect()]


def test_time_limit_and_profile(spark, tmp_path, caplog):
    graph = made(spark)
    files.write_node_link(graph, str(tmp_path / "g"))
    with caplog.at_level("INFO", "thornweave"):
        early = cli.run(spark, EngineConfig(str(tmp_path / "g"), TRIANGLE, 1, 9, 1e-9, profile=True))
    assert keys(early) == keys(match.exact(graph.up_to(0), parse(TRIANGLE), distinct=True)) and "cumulative" in caplog.text and "step 1" not in caplog.text
    part = cli.run(spark, EngineConfig(str(tmp_path / "g"), TRIANGLE, 9, 0, 1e-9), batch=True)
    assert set(keys(part)) < set(keys(match.exact(graph, parse(TRIANGLE), distinct=True)))


def test_a_batch_that_runs_again(spark, tmp_path):
    """The second attempt of an epoch writes what the first wrote, in this process and after a restart."""
    graph, query = made(spark), parse(TRIANGLE)
    state = str(tmp_path / "state")
    matcher = incremental.IncrementalMatcher(graph.up_to(1), query, state=state)
    taken = []

    class Stream:
        @property
        def writeStream(self):
            return self

        def foreachBatch(self, f):
            taken.append(f)
            return self

        option = trigger = lambda self, *a, **b: self

        def start(self):
            return None

    out = str(tmp_path / "out")
    incremental.stream(Stream(), matcher, out, str(tmp_path / "c"))
    batch = graph.edges.filter("add = 2")
    taken[0](batch, 0)
    first = keys(spark.read.parquet(f"{out}/epoch=0"))
    assert first == sorted(set(keys(match.exact(graph.up_to(2), query, distinct=True))) - set(keys(match.exact(graph.up_to(1), query, distinct=True)))) and first
    taken[0](batch, 0)
    assert keys(spark.read.parquet(f"{out}/epoch=0")) == first and len(matcher.metrics) == 1
    again = incremental.IncrementalMatcher.resume(spark, query, state)
    assert again.metrics == matcher.metrics and keys(again.matches) == keys(matcher.matches)
    incremental.stream(Stream(), again, out, str(tmp_path / "c"))
    taken[1](batch, 0)
    assert keys(spark.read.parquet(f"{out}/epoch=0")) == first and len(again.metrics) == 1
    taken[1](graph.edges.filter("add = 3"), 1)
    assert keys(again.matches) == keys(match.exact(graph.up_to(3), query, distinct=True)) and again.matches.count() == again.metrics[-1].total


def test_a_step_that_breaks_off(spark, tmp_path, monkeypatch):
    graph, query = made(spark), parse(TRIANGLE)
    matcher = incremental.IncrementalMatcher(graph.up_to(2), query, state=str(tmp_path / "s"))
    before = keys(matcher.matches)
    monkeypatch.setattr(matcher, "_mark", lambda m: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        matcher.step(graph.edges.filter("add = 3"), 3)
    assert keys(matcher.matches) == before and keys(incremental.IncrementalMatcher.resume(spark, query, str(tmp_path / "s")).matches) == before
    monkeypatch.undo()
    assert matcher.step(graph.edges.filter("add = 3"), 3).new > 0 and keys(matcher.matches) == keys(match.exact(graph, query, distinct=True))


def test_guided_mode_resumes(spark, tmp_path):
    graph, query = made(spark, 2), parse(TRIANGLE)
    one = incremental.IncrementalMatcher(graph.up_to(1), query, "guided", 4, state=str(tmp_path / "s"))
    two = incremental.IncrementalMatcher.resume(spark, query, str(tmp_path / "s"), "guided", 4)
    assert sorted(map(tuple, two.walk.collect())) == sorted(map(tuple, one.walk.collect())) and sorted(map(str, two.paths.collect())) == sorted(map(str, one.paths.collect()))
    two.step(graph.edges.filter("add = 2"), 2)
    assert two.graph.edges.count() == graph.up_to(2).edges.count()
