"""Components against a plain search."""

import random

import pytest

from thornweave.operators import components


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x] - set(out)
    return out


def cases():
    rng = random.Random(1)
    yield [(i, i + 1) for i in range(120)] + [(500, 500), (-3, 700)]
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    yield [(0, i) for i in range(1, 200)] + [(1000 + i % 7, 1000 + i % 5) for i in range(30)]


@pytest.mark.parametrize("edges", list(cases()))
@pytest.mark.parametrize("together", [500_000, 25])
def test_components(spark, monkeypatch, edges, together):
    monkeypatch.setattr(components, "TOGETHER", together)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    rows = components.connected_components(df).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == brute(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


@pytest.mark.parametrize("edges", list(cases()))
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_updated(spark, edges, share):
    """Components after more edges, from those before, are those of all edges; new ids may be smaller than known ones."""
    cut = int(len(edges) * share)
    old, new = ([tuple(e) for e in part] for part in (edges[:cut], [*edges[cut:], (-50, edges[0][0]), (9_000, 9_001)]))
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    rows = components.updated(components.connected_components(frame(old)), frame([*new, (None, 3)])).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == brute(old + new)
