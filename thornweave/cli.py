"""python -m thornweave.cli CONFIG.ini [--mode exact|guided] [--batch]: replays a graph's steps through a query."""

from __future__ import annotations

import argparse
import cProfile
import io
import logging
import pstats

from pyspark.sql import DataFrame, SparkSession

from .graph import PropertyGraph
from .operators import match, results
from .plans.query import PatternQuery, parse
from .sources.config import EngineConfig, read_config
from .sources.files import read_node_link
from .streaming.incremental import replay, replay_batch

log = logging.getLogger("thornweave")


def post_processed(found: DataFrame, graph: PropertyGraph, query: PatternQuery) -> DataFrame:
    """Matches as the query asks for them: aggregated (by group), grouped, ordered, or as they are."""
    if query.aggregates:
        return results.aggregated(found, graph, list(query.aggregates), list(query.groupby))
    if query.groupby:
        return results.grouped(found, graph, list(query.groupby))
    return results.ordered(found, graph, list(query.orderby), query.descending) if query.orderby else found


def run_query(graph: PropertyGraph, text: str, mode: str = "exact", **options) -> DataFrame:
    """A query's answer on a graph. Aggregates and groups are over all bindings, what else there is over subgraphs."""
    query = parse(text)
    options.setdefault("distinct", not (query.aggregates or query.groupby))
    return post_processed(match.find(graph, query, mode, **options), graph, query)


def run(spark: SparkSession, config: EngineConfig, mode: str = "exact", batch: bool = False) -> DataFrame:
    """Replays the configured steps, logs each, and returns the answer after the last, as run_query() gives it for that snapshot.

    config.time_limit: seconds after which no further step (batch: no further chunk of a snapshot's seeds) is begun.
    config.profile: what the driver spent its time on is logged at the end; executors' work is in Spark's event log.
    """
    profiler = cProfile.Profile() if config.profile else None
    if profiler:
        profiler.enable()
    graph, query = read_node_link(spark, config.input_json), parse(config.query)
    found, distinct = None, not (query.aggregates or query.groupby)
    if batch:
        for step, found, seconds in replay_batch(graph, query, config.base_steps, config.steps, "greedy" if mode == "guided" else mode, distinct, config.time_limit):
            log.info("step %s: %d patterns in %.3f s", step, found.count(), seconds)
    else:
        for matcher, m in replay(graph, query, config.base_steps, config.steps, config.time_limit, mode=mode, distinct=distinct):
            found = matcher.matches
            if m is not None:
                log.info("step %d: %d edges, %d new patterns, %d in all, %.3f s, %.1f a second", m.step, m.edges, m.new, m.total, m.elapsed, m.throughput)
    if profiler:
        profiler.disable()
        text = io.StringIO()
        pstats.Stats(profiler, stream=text).sort_stats("cumulative").print_stats(30)
        log.info("profile of the driver:\n%s", text.getvalue())
    return post_processed(found, graph, query)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("config")
    args.add_argument("--mode", default="exact", choices=["exact", "guided"])
    args.add_argument("--batch", action="store_true", help="match each snapshot from the beginning")
    given = args.parse_args()
    config = read_config(given.config)
    logging.basicConfig(level=config.level.upper())
    spark = SparkSession.builder.appName("thornweave").config("spark.sql.shuffle.partitions", str(max(8, config.num_proc))).getOrCreate()
    run(spark, config, given.mode, given.batch).show(100, truncate=False)


if __name__ == "__main__":
    main()
