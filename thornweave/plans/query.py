"""Pattern queries as text: flags that name vertices, edges, paths, labels, a condition and what to do with the matches."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class QueryEdge:
    name: str
    src: str
    dst: str
    label: str = ""
    path: bool = False


@dataclass(frozen=True)
class PatternQuery:
    vertices: tuple[str, ...]
    edges: tuple[QueryEdge, ...]
    labels: dict[str, str] = field(default_factory=dict)
    condition: str = ""
    directed: bool = False
    groupby: tuple[str, ...] = ()
    orderby: tuple[str, ...] = ()
    descending: bool = False
    aggregates: tuple[str, ...] = ()

    @property
    def has_path(self) -> bool:
        return any(e.path for e in self.edges)

    def check(self) -> PatternQuery:
        """Raises QueryError for what can never match: unknown symbols, no edges, parts that no edge joins."""
        known = set(self.vertices)
        if not self.vertices or len(known) < len(self.vertices):
            raise QueryError("vertices are named once each, and there is one at least")
        for e in self.edges:
            if not {e.src, e.dst} <= known:
                raise QueryError(f"edge {e.name} has an end that is no vertex")
            if e.path and e.src == e.dst:
                raise QueryError(f"path {e.name} ends where it starts")
        if unknown := set(self.labels) - known:
            raise QueryError(f"label for what is no vertex: {sorted(unknown)}")
        reached, before = {self.vertices[0]}, 0
        while len(reached) > before:
            before = len(reached)
            for e in self.edges:
                if {e.src, e.dst} & reached:
                    reached |= {e.src, e.dst}
        if reached != known:
            raise QueryError(f"no edge joins {sorted(known - reached)} to the rest")
        return self


#: Flags that take values, by the name of what they fill.
_FLAGS = {"--vertex", "--edge", "--path", "--vertexlabel", "--edgelabel", "--condition", "--groupby", "--orderby", "--aggregate", "--graph", "--directed", "--desc"}


def parse(text: str) -> PatternQuery:
    """--vertex a b --edge e:a:b --path p:a:b --vertexlabel a:L --edgelabel e:L --condition EXPR --directed --groupby a.x --orderby a.x [--desc] --aggregate MAX:a.x

    A condition of several words may be quoted or not; everything up to the next flag belongs to it. --graph is accepted
    and ignored.
    """
    values: dict[str, list[str]] = {f: [] for f in _FLAGS}
    given, flag = set(), None
    for word in shlex.split(text):
        if word.startswith("--"):
            if word not in _FLAGS:
                raise QueryError(f"unknown flag {word}")
            flag = word
            given.add(flag)
        elif flag is None or flag in ("--directed", "--desc"):
            raise QueryError(f"{word} belongs to no flag")
        else:
            values[flag].append(word)

    def split(flag: str, n: int) -> list[list[str]]:
        out = [v.split(":", n - 1) for v in values[flag]]
        if bad := [v for v, x in zip(values[flag], out, strict=True) if len(x) < n or not all(x[: n - 1])]:
            raise QueryError(f"{flag} takes {n} parts joined by colons: {bad[0]}")
        return out

    labels = dict(split("--edgelabel", 2))
    edges = [QueryEdge(name, a, b, labels.get(name, ""), False) for name, a, b in split("--edge", 3)]
    edges += [QueryEdge(name, a, b, labels.get(name, ""), True) for name, a, b in split("--path", 3)]
    if len({e.name for e in edges}) < len(edges):
        raise QueryError("edges and paths are named once each")
    if unknown := set(labels) - {e.name for e in edges}:
        raise QueryError(f"label for what is no edge: {sorted(unknown)}")
    return PatternQuery(
        tuple(values["--vertex"]),
        tuple(edges),
        dict(split("--vertexlabel", 2)),
        " ".join(values["--condition"]),
        "--directed" in given,
        tuple(values["--groupby"]),
        tuple(values["--orderby"]),
        "--desc" in given,
        tuple(values["--aggregate"]),
    ).check()
