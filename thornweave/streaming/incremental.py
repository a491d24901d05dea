"""Matching while edges arrive.

The exact way finds, for each batch of new edges, the matches that use one of them at least: one of the query's edges is taken
from the batch, those written before it from the graph as it was and those after it from the graph as it is, so each new
match is found once. The guided way recomputes walks, paths and matches only for vertices whose communities the
batch touches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGES, PropertyGraph
from ..operators import community, match, partition, paths, results, walk
from ..operators.ranking import with_rank
from ..plans.planner import symmetry_breaks
from ..plans.query import PatternQuery
from ..storage import ROWS_A_FILE, fresh_path, materialise, small


def new_matches(before: PropertyGraph, delta: DataFrame, after: PropertyGraph, query: PatternQuery, max_path_edges: int = match.MAX_PATH_EDGES, distinct: bool = False, edges: int | None = None) -> DataFrame:
    """Matches in `after` that aren't in `before`, as bindings, or one for each subgraph; delta: the edges that `after` has more.

    edges: how many these are, where that is known; few ones are broadcast to the graph's edges, which then needn't be shuffled for them.
    Each is found once. A query with paths is matched anew, and what was there is taken off: a path may use an old and a new edge together.
    """
    if query.has_path:
        keys = [f"v_{s}" for s in query.vertices] + [f"k_{e.name}" for e in query.edges if not e.path] + [f"p_{e.name}" for e in query.edges if e.path]
        now, old = (match.bindings(g, query, max_path_edges) for g in (after, before))
        found = match.as_matches(now.join(old, keys, "left_anti").select(*now.columns), after, query)
        return results.distinct(found) if distinct else found
    own = replace(after, edges=delta.select(*after.edges.columns))
    less, same, complete = symmetry_breaks(query) if distinct and not query.condition.strip() else ([], [], False)
    found, (old, batch, now) = None, (g.adjacency() for g in (before, own, after))
    for j, e in enumerate(query.edges):  # the batch's edge comes first, so that hubs of the graph are only gone through from it
        ways = {f.name: old if i < j else batch if i == j else now for i, f in enumerate(query.edges)}
        rows = match.bindings(after, query, max_path_edges, None, ways, (less, same), first_edge=e.name, first_rows=None if edges is None else 2 * edges)
        found = rows if found is None else found.unionByName(rows)
    found = match.as_matches(found, after, query)
    return results.distinct(found) if distinct and not complete else found


@dataclass
class StepMetrics:
    step: int
    edges: int
    new: int
    total: int
    recomputed: int
    elapsed: float

    @property
    def throughput(self) -> float:
        return self.new / self.elapsed if self.elapsed > 0 else 0.0


#: Tables of so many steps are merged into one, and so many of those again.
FAN = 8
#: Rows of a file of a merged table.
ROWS_MERGED = 1_000_000

_MARK = "seq long, step long, edges long, new long, total long, recomputed long, elapsed double, directed boolean, multi boolean"


class IncrementalMatcher:
    """Holds a graph, its matches and, for the guided mode, walks and paths, as tables in a shared folder.

    mode: exact, or guided with communities of fewer than `community_size` vertices. Matches are kept one for each subgraph, or,
    without `distinct`, as all bindings, which groups and aggregates need. A step only adds to the tables of edges, vertices
    and matches what is new, so its cost follows the batch and what it completes, not what there is already. A step that is
    given again (a batch that is retried) finds nothing new. After FAN steps their tables are merged into one, after FAN of those
    these again: what is read at a step are some FAN tables for each power of FAN, and a row is written once for each power.
    The merged ones stay, since matches of a single step may still be asked for, and tables read before go on to be valid.

    state: a folder of its own, by default a fresh one. A step counts once its mark is written, last of all; resume()
    goes on from the last mark, and what a step that broke off has left is written anew.
    """

    def __init__(self, graph: PropertyGraph, query: PatternQuery, mode: str = "exact", community_size: int = 10, approximate: bool = False, max_path_edges: int = match.MAX_PATH_EDGES, distinct: bool = True, state: str | None = None):
        self._set(graph.vertices.sparkSession, query, mode, community_size, approximate, max_path_edges, distinct, state)
        self.directed, self.multi, self.seq = graph.directed, graph.multi, 0
        self._keep("vertices", graph.vertices)
        self._keep("edges", graph.edges)
        self.schemas = {"vertices": graph.vertices.schema, "edges": graph.edges.schema}
        if mode == "guided":
            self._keep("walk", walk.random_walk(self.graph))
            self._keep("paths", paths.best_paths(self.graph, self.walk))
            found = match.guided(self.graph, query, self.walk, approximate)
        else:
            found = match.exact(self.graph, query, max_path_edges)
        found = results.distinct(found) if distinct else found
        self.schemas["matches"] = found.schema
        self._keep("matches", found)
        self._mark(StepMetrics(-1, 0, 0, self.matches.count(), 0, 0.0))

    def _set(self, spark: SparkSession, query: PatternQuery, mode: str, community_size: int, approximate: bool, max_path_edges: int, distinct: bool, state: str | None) -> None:
        if mode not in ("exact", "guided"):
            raise ValueError(f"no mode {mode}")
        self.spark, self.state = spark, state or fresh_path(spark, "incremental")
        self.query, self.mode, self.community_size, self.approximate, self.max_path_edges, self.distinct = query, mode, community_size, approximate, max_path_edges, distinct
        self.metrics: list[StepMetrics] = []
        self.affected, self.merged = None, 0

    @classmethod
    def resume(cls, spark: SparkSession, query: PatternQuery, state: str, mode: str = "exact", community_size: int = 10, approximate: bool = False, max_path_edges: int = match.MAX_PATH_EDGES, distinct: bool = True) -> IncrementalMatcher:
        """The matcher as it was after the last step that was finished in this folder. The options are those that it was made with."""
        own = cls.__new__(cls)
        own._set(spark, query, mode, community_size, approximate, max_path_edges, distinct, state)
        marks = spark.read.schema(_MARK).parquet(f"{state}/marks/*").orderBy("seq").collect()  # one row a step
        own.directed, own.multi, own.seq = marks[0].directed, marks[0].multi, marks[-1].seq
        own.merged = own.seq
        own.metrics = [StepMetrics(m.step, m.edges, m.new, m.total, m.recomputed, m.elapsed) for m in marks[1:]]
        own.total = marks[-1].total
        own.schemas = {n: spark.read.parquet(own._path(n, 0)).schema for n in ("vertices", "edges", "matches")}
        return own

    def _path(self, name: str, seq: int) -> str:
        return f"{self.state}/{name}/seq={seq}"

    def _keep(self, name: str, df: DataFrame, rows: int | None = None) -> None:
        """rows: about how many there are, where that is known; it decides into how many files they go."""
        df = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        df.write.mode("overwrite").parquet(self._path(name, self.seq))

    def _mark(self, m: StepMetrics) -> None:
        row = (self.seq, m.step, m.edges, m.new, m.total, m.recomputed, float(m.elapsed), self.directed, self.multi)
        named = [F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(row, (c.split() for c in _MARK.split(", ")), strict=True)]
        self.spark.range(0, 1, 1, 1).select(*named).write.mode("overwrite").parquet(self._path("marks", self.seq))
        self.total, self.merged = m.total, self.seq

    def _block(self, name: str, end: int, size: int) -> str:
        """Where the tables of so many steps are, the last of them `end`."""
        return self._path(name, end) if size == 1 else f"{self.state}/{name}/merged={end - size + 1}-{end}"

    def _blocks(self, name: str, start: int, end: int, most: int) -> list[str]:
        """Paths of the steps after start up to end, in blocks that are merged already, of at most so many steps."""
        found = []
        while start < end:
            size = 1
            while size * FAN <= most and start % (size * FAN) == 0 and start + size * FAN <= min(end, self.merged):
                size *= FAN
            start += size
            found.append(self._block(name, start, size))
        return found

    def _merge(self) -> None:
        """Merges the tables of the last steps, where a block of them is full. A step's mark follows, so what is marked is merged."""
        size = FAN
        while self.seq % size == 0:
            for name in ("vertices", "edges", "matches"):
                parts = self.spark.read.schema(self.schemas[name]).parquet(*self._blocks(name, self.seq - size, self.seq, size // FAN))
                parts.coalesce(-(-parts.count() // ROWS_MERGED) or 1).write.mode("overwrite").parquet(self._block(name, self.seq, size))
            size *= FAN

    def _read(self, name: str, last: int | None = None) -> DataFrame:
        last = self.seq if last is None else last
        return self.spark.read.schema(self.schemas[name]).parquet(self._path(name, 0), *self._blocks(name, 0, last, max(last, 1)))

    def _graph(self, last: int | None = None) -> PropertyGraph:
        return PropertyGraph(self._read("vertices", last), self._read("edges", last), self.directed, self.multi)

    @property
    def graph(self) -> PropertyGraph:
        return self._graph()

    @property
    def matches(self) -> DataFrame:
        return self._read("matches")

    @property
    def walk(self) -> DataFrame | None:
        return self.spark.read.parquet(self._path("walk", self.seq)) if self.mode == "guided" else None

    @property
    def paths(self) -> DataFrame | None:
        return self.spark.read.parquet(self._path("paths", self.seq)) if self.mode == "guided" else None

    def new_of(self, step: int) -> DataFrame | None:
        """The matches that a step added; None if it wasn't taken. The first one counts where a number was given again."""
        at = next((i + 1 for i, m in enumerate(self.metrics) if m.step == step), None)
        return None if at is None else self.spark.read.schema(self.schemas["matches"]).parquet(self._path("matches", at))

    def _fresh(self, before: PropertyGraph, delta: DataFrame) -> tuple[DataFrame, int]:
        """(edges, how many at most): what a batch has that the graph lacks: each pair and key once. The graph is gone through beside the batch's keys, not shuffled."""
        keys = ["src", "dst", "key"]
        own = PropertyGraph(before.vertices, delta.select(*before.edges.columns), self.directed).pairs()
        own = own.groupBy(*keys).agg(F.min(F.struct("add", "label", F.map_entries("props").alias("p"))).alias("e"))
        own = own.select(*keys, "e.label", "e.add", F.map_from_entries("e.p").alias("props"))
        own = materialise(own.select(*before.edges.columns), "batch")
        n = own.count()
        there = before.pairs().join(small(own.select(*keys), n), keys, "left_semi").select(*keys)
        return own.join(small(there, n), keys, "left_anti").select(*before.edges.columns), n

    def _ends(self, before: PropertyGraph, ends: DataFrame, rows: int, vertices: DataFrame | None) -> DataFrame:
        """Vertices that come with a batch: rows of `vertices` where they are known there, empty ones else."""
        there = before.vertices.join(small(ends, rows), "id", "left_semi").select("id")
        new = ends.join(small(there, rows), "id", "left_anti")
        empty = new.select("id", F.lit("").alias("label"), F.create_map().cast("map<string,string>").alias("props"))
        if vertices is None:
            return empty
        known = vertices.join(small(new, rows), "id", "left_semi").select("id", "label", "props")
        return known.unionByName(empty.join(small(known.select("id"), rows), "id", "left_anti"))

    def step(self, delta: DataFrame, number: int = 0, vertices: DataFrame | None = None) -> StepMetrics:
        """Takes a batch of edges in and returns what came of it."""
        began, last = time.time(), self.seq
        before, old = self._graph(), self.matches
        kept = {"walk": self.walk, "paths": self.paths}
        self.seq = last + 1
        try:
            new_edges, most = self._fresh(before, delta)
            self._keep("edges", new_edges, most)
            fresh_edges = self.spark.read.schema(self.schemas["edges"]).parquet(self._path("edges", self.seq))
            ends = fresh_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            self._keep("vertices", self._ends(before, ends, 2 * most, vertices).select(*before.vertices.columns), 2 * most)
            after, recomputed = self._graph(), 0
            if self.mode == "exact":
                new = new_matches(before, fresh_edges, after, self.query, self.max_path_edges, self.distinct, most)
            else:
                parts = materialise(community.recursive_communities(before, self.community_size), "communities")
                self.affected = community.affected_counts(parts, ends)
                seeds = materialise(community.affected(parts, ends), "affected")
                recomputed = seeds.count()
                self._keep("walk", walk.update(kept["walk"], after, seeds))
                self._keep("paths", paths.update(kept["paths"], after, self.walk, seeds))
                found = match.guided(after, self.query, self.walk, self.approximate, seeds)
                keys = ["canon_key"] if self.distinct else [c for c in found.columns if c.startswith("v_")] + ["canon_key"]
                new = (results.distinct(found) if self.distinct else found.dropDuplicates(keys)).join(old.select(*keys), keys, "left_anti")
            self._keep("matches", new.select(*old.columns))
            n_edges, n_new = fresh_edges.count(), self.spark.read.schema(old.schema).parquet(self._path("matches", self.seq)).count()
            self._merge()
            metrics = StepMetrics(number, n_edges, n_new, self.total + n_new, recomputed, time.time() - began)
            self._mark(metrics)
        except BaseException:
            self.seq = last  # as if the step had not begun
            raise
        self.metrics.append(metrics)
        return metrics

    def report(self) -> DataFrame:
        """One row for each step."""
        rows = [(m.step, m.edges, m.new, m.total, m.recomputed, m.elapsed, m.throughput) for m in self.metrics]
        return self.spark.createDataFrame(rows, "step long, edges long, new long, total long, recomputed long, elapsed double, throughput double")


def step_list(graph: PropertyGraph) -> list[int]:
    """The steps there are, in order; one number each comes to the driver."""
    return [r["add"] for r in graph.edges.filter("add IS NOT NULL").select("add").distinct().orderBy("add").collect()]


def replay(graph: PropertyGraph, query: PatternQuery, base_steps: int, max_steps: int, seconds: float = 0.0, clock: Callable[[], float] = time.time, **options) -> Iterator[tuple[IncrementalMatcher, StepMetrics | None]]:
    """First the matcher over the first `base_steps` steps (with edges that have none), then one batch for each step after.

    A graph whose edges have no steps is one snapshot. seconds: no further step is begun once they are over; 0 or less set no limit.
    """
    began = clock()
    steps = step_list(graph)
    base = graph.up_to(steps[min(base_steps, len(steps)) - 1]) if steps and base_steps > 0 else graph._with_ends(graph.edges.filter("add IS NULL"))
    matcher = IncrementalMatcher(base, query, **options)
    yield matcher, None
    for s in steps[base_steps : base_steps + max_steps]:
        if seconds > 0 and clock() - began >= seconds:
            return
        yield matcher, matcher.step(graph.edges.filter(F.col("add") == s), s, graph.vertices)


def replay_batch(graph: PropertyGraph, query: PatternQuery, base_steps: int, max_steps: int, mode: str = "exact", distinct: bool = True, seconds: float = 0.0) -> Iterator[tuple[int | None, DataFrame, float]]:
    """The same snapshots, each matched from the beginning: (step, matches, seconds). seconds: a limit for each snapshot, as in anytime()."""
    steps = step_list(graph) or [None]
    base = min(base_steps, len(steps))
    for s in steps[max(0, base - 1) : base + max_steps]:
        began, now = time.time(), graph if s is None else graph.up_to(s)
        found = anytime(now, query, seconds, mode=mode, distinct=distinct)[0] if seconds > 0 else match.find(now, query, mode, distinct)
        found = materialise(found, "snapshot")
        yield s, found, time.time() - began


def anytime(graph: PropertyGraph, query: PatternQuery, seconds: float, chunks: int = 8, known: DataFrame | None = None, clock: Callable[[], float] = time.time, distinct: bool = True, **options) -> tuple[DataFrame, int]:
    """(matches, chunks of seeds done): seeds are taken in chunks, vertices in `known` (id, rank) first, until the time is up.

    At least one chunk is done; 0 seconds or less set no limit. distinct: one match for each subgraph, else all bindings.
    """
    seeds = match.seeds_of(graph, query)
    if known is not None:
        seeds = seeds.join(known.select("id", "rank"), "id", "left")
        first = materialise(partition.seed_chunks(seeds.filter("rank IS NOT NULL"), chunks), "seeds")
        rest = partition.seed_chunks(seeds.filter("rank IS NULL"), chunks).withColumn("chunk", F.col("chunk") + chunks)
        dealt, chunks = materialise(first.union(rest), "seeds"), 2 * chunks
    else:
        dealt = materialise(partition.seed_chunks(seeds, chunks), "seeds")
    began, found, done = clock(), None, 0
    for c in range(chunks):
        part = materialise(match.find(graph, query, distinct=distinct, seeds=dealt.filter(F.col("chunk") == c), **options), "chunk")
        found = part if found is None else found.unionByName(part)
        done += 1
        if seconds > 0 and clock() - began >= seconds:
            break
    return results.distinct(found) if distinct else found, done


def update_known(known: DataFrame, ids: DataFrame) -> DataFrame:
    """known (id, rank) with ids that it lacks after the others, in order of id."""
    new = with_rank(ids.select("id").distinct().join(known, "id", "left_anti").select("id"), "id", name="n")
    last = known.agg(F.coalesce(F.max("rank"), F.lit(-1)).alias("last")).first()["last"]
    return known.select("id", "rank").union(new.select("id", (F.lit(last) + 1 + F.col("n")).alias("rank")))


def stream(edges: DataFrame, matcher: IncrementalMatcher, out: str | None = None, checkpoint: str | None = None, trigger: dict | None = None):
    """Feeds a streaming DataFrame of edges (as in EDGES) to the matcher, one micro-batch a step; returns the StreamingQuery.

    out: a folder that gets each batch's new matches under its own number. A batch that runs again, also after resume(), isn't
    taken in twice, and its output is written again as it was.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        if matcher.new_of(epoch) is None:
            matcher.step(batch, epoch)
        if out:
            matcher.new_of(epoch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return edges.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or fresh_path(matcher.spark, "stream")).trigger(**(trigger or {"availableNow": True})).start()


def edge_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A stream of Parquet files of edges."""
    return spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_each).parquet(folder)


def stepped(stream_: DataFrame, time_column: str, lateness: str, width: str = "1 day") -> DataFrame:
    """A stream of (src, dst, time) with `add`, the number of its window since 1970. Later ones than `lateness` may be dropped by what follows."""
    marked = stream_.withWatermark(time_column, lateness).withColumn("_w", F.window(time_column, width))
    return marked.withColumn("add", F.floor(F.unix_timestamp("_w.start") / (F.unix_timestamp("_w.end") - F.unix_timestamp("_w.start")))).drop("_w")


def delta_counts(graph: PropertyGraph, query: PatternQuery) -> DataFrame:
    """(add, matches): subgraphs by the step that completes them, in one pass over the whole graph."""
    found = match.exact(graph, query, distinct=True)
    last = found.select("canon_key", F.explode("edges").alias("e")).select("canon_key", "e.*")
    a = graph.pairs().select("src", "dst", "key", "add")
    return last.join(a, ["src", "dst", "key"]).groupBy("canon_key").agg(F.max("add").alias("add")).groupBy("add").agg(F.count("*").alias("matches"))
