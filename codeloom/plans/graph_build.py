"""End-to-end compositions (one distributed job per stage, all packages at once)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.session import cut_lineage


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    """Reuse a DataFrame read by several outputs without recomputing it.

    ``checkpoint`` writes it to the shared folder, which Spark cleans up once
    nothing refers to it; ``persist`` caches it, and the caller unpersists it.
    """
    if how == "none":
        return df
    if how == "persist":
        from pyspark import StorageLevel

        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        return cut_lineage(df)
    raise ValueError(f"unknown stage mode {how!r}")


def at_once(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that do not need each other, their jobs submitted side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def build_graph(
    src: DataFrame,
    entries: DataFrame,
    calls: DataFrame,
    log: DataFrame,
    roots: DataFrame,
    normalize_callers: bool = False,
    use_marker: bool = True,
    include_async: bool = False,
    distinct_edges: bool = False,
    stage: str = "checkpoint",
    partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Function graph of every package.

    ``src``: ``package, path, content``; ``entries``: ``package, function``;
    ``calls``: ``package, caller, callee``; ``log``: ``package, line_no, line``;
    ``roots``: ``package, root``.  Returns ``nodes`` (functions on some edge),
    ``edges``, ``errors`` (unparseable files), ``unmatched`` (entries without a
    logged path), ``completeness`` and ``status`` per package.

    Only log lines after the phase marker, as many as announced, name paths;
    ``use_marker=False`` takes every counter line.  What several outputs read
    (functions, logged paths, edges) is staged once, as ``stage`` says; the files
    are parsed while the log and the calls are.
    """
    def functions():
        return X.split_errors(materialize(X.extract_functions(src, include_async, partitions), stage))

    def call_edges():
        logged = materialize(G.log_entries(G.after_marker(log) if use_marker else log, roots), stage)
        resolved, unmatched = G.attach_paths(entries, G.name_to_path(logged))
        return logged, unmatched, materialize(G.resolve_edges(calls, resolved, normalize_callers, distinct=distinct_edges), stage)

    (fns, errors), (logged, unmatched, edges) = at_once(src.sparkSession, functions, call_edges)
    nodes = X.function_nodes(fns, roots)
    return {
        "nodes": G.nodes_in_graph(nodes, edges),
        "edges": edges,
        "errors": errors,
        "unmatched": unmatched,
        "completeness": G.mapping_completeness(nodes, edges),
        "status": G.package_status(roots, log=logged, nodes=nodes, edges=edges),
    }
