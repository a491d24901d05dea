"""The registered queries against their SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from thornweave import queries


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], Counter(tuple(str(value(r[i])) for i in order) for r in rows)


def compare(frame, sql, sf):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def test_queries_without_sql():
    """Communities come of rounds of moves, and parts are cut along them; tests/test_graph.py holds both against brute force."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"communities", "overlapping_parts"}


def test_communities(spark, sf):
    """Every user is in one community, named by its smallest member, and all that is left whole holds together."""
    graph = queries.tables.purchase_succession(spark, sf)
    of = {r.id: r.community for r in queries.QUERIES["communities"](spark, sf).collect()}
    assert sorted(of) == sorted(r.id for r in graph.vertices.collect())
    members = {}
    for i, c in of.items():
        members.setdefault(c, set()).add(i)
    assert all(min(m) == c for c, m in members.items())
    near = {}
    for r in graph.edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    whole = [m for m in members.values() if len(m) >= 40]
    for m in whole:
        seen, frontier = set(), [min(m)]
        while frontier:
            x = frontier.pop()
            seen.add(x)
            frontier += [y for y in near.get(x, ()) if y in m and y not in seen]
        assert seen == m


def test_overlapping_parts(spark, sf):
    """Four parts as even as can be; what lies one edge around them is counted once."""
    graph = queries.tables.purchase_succession(spark, sf)
    n = graph.vertices.count()
    found = {(r.part, r.distance): r.vertices for r in queries.QUERIES["overlapping_parts"](spark, sf).collect()}
    inner = sorted(found[p, 0] for p in range(4))
    assert sum(inner) == n and inner[-1] - inner[0] <= 1 and all(found[p, 0] + found.get((p, 1), 0) <= n for p in range(4))
