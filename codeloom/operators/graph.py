"""Call-graph cleaning and resolution as DataFrame operators.

Inputs are long tables keyed by ``package`` so every package of a corpus is
handled by one job:

* ``entries``: ``package, function`` (one row per call-graph entry);
* ``calls``: ``package, caller, callee`` (one row per listed callee);
* ``log``: ``package, line_no, line`` (analyzer output, in line order);
* ``roots``: ``package, root`` (folder of the package as logged).

All lookups are equi-joins on ``(package, key)`` whose build side is made
unique first, so a hot callee only skews the probe side, which AQE's skew-join
handling splits.  No step collects a package into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions.predicates import is_user_function, not_builtin

PKG = "package"


# ---------------------------------------------------------------------------
# analyzer log
LINES_PER_BUCKET = 1 << 20


def after_marker(log: DataFrame) -> DataFrame:
    """Counter lines after the phase marker and the ``… functions will be
    analyzed.`` header, cut after the count announced by the first line that
    follows the header.  Packages without marker/header/count yield nothing.

    The log is read twice: for its few marker and header lines, and for the
    lines after them, which are dealt by ranges of line numbers; the place of a
    line is its place in the range plus the counter lines of the ranges before.
    The headers, one row per package, are sent to the log: it is not dealt by
    package, whatever it is made of.
    """
    marker, suffix = F.col("line").contains(N.PHASE_MARKER), F.col("line").endswith(N.HEADER_SUFFIX)
    # on the marker's own line the header must follow the marker
    tail = F.substr("line", F.instr("line", N.PHASE_MARKER)).endswith(N.HEADER_SUFFIX)
    special = log.filter(marker | suffix) \
        .select(PKG, "line_no", marker.alias("_marker"), suffix.alias("_header"), (marker & tail).alias("_both")).repartition(PKG)
    start = special.filter("_marker").groupBy(PKG).agg(F.min("line_no").alias("_m"))
    header = special.join(start, PKG).filter((F.col("line_no") > F.col("_m")) & F.col("_header") | (F.col("line_no") == F.col("_m")) & F.col("_both")) \
        .groupBy(PKG).agg(F.min("line_no").alias("_h"))
    after = log.join(F.broadcast(header), PKG).filter(F.col("line_no") > F.col("_h")) \
        .select(PKG, "line_no", "line", N.parse_progress("line")["n"].alias("_n"),
                F.floor(F.col("line_no") / F.lit(LINES_PER_BUCKET)).alias("_bucket")).repartition(PKG, "_bucket")
    ranges = after.groupBy(PKG, "_bucket").agg(F.count("_n").alias("_cnt"), F.min(F.struct("line_no", "_n")).alias("_first"))
    whole = Window.partitionBy(PKG).orderBy("_bucket")
    ranges = ranges.select(
        PKG, "_bucket", F.coalesce(F.sum("_cnt").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.min("_first").over(Window.partitionBy(PKG))["_n"].alias("_expected"))
    place = F.row_number().over(Window.partitionBy(PKG, "_bucket").orderBy("line_no"))
    counters = after.filter(F.col("_n").isNotNull()).withColumn("_rn", place).join(ranges, [PKG, "_bucket"])
    return counters.filter(F.col("_rn") + F.col("_off") <= F.col("_expected")).select(PKG, "line_no", "line")


def phase_flag(log: DataFrame) -> DataFrame:
    """``after_marker``: the line lies after the first phase-marker line of
    its package (the running flag, from one small aggregate and a join rather
    than a window over the whole log)."""
    marker = log.filter(F.col("line").contains(N.PHASE_MARKER)).groupBy(PKG).agg(F.min("line_no").alias("_m"))
    out = log.join(F.broadcast(marker), PKG, "left")
    return out.withColumn("after_marker", F.coalesce(F.col("line_no") > F.col("_m"), F.lit(False))).drop("_m")


def log_entries(log: DataFrame, roots: DataFrame) -> DataFrame:
    """``package, line_no, name, rel_path`` for every counter line."""
    parsed = log.filter(N.parse_progress("line").isNotNull()).join(F.broadcast(roots), PKG) \
        .select(PKG, "line_no", N.parse_log_entry("line", F.col("root")).alias("e"))
    return parsed.filter(F.col("e").isNotNull()).select(PKG, "line_no", "e.name", "e.rel_path")


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Dictionary building: one row per key, value of the last row by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def name_to_path(entries: DataFrame) -> DataFrame:
    """``package, name, rel_path``: last logged path of each bare name."""
    return last_wins(entries, [PKG, "name"], "rel_path", "line_no")


def ambiguous_names(entries: DataFrame) -> DataFrame:
    """``package, name, n_paths`` for names logged with more than one path
    (they all resolve to the last one)."""
    paths = entries.select(PKG, "name", "rel_path").distinct()
    return paths.groupBy(PKG, "name").agg(F.count(F.lit(1)).alias("n_paths")).filter(F.col("n_paths") > 1)


def log_count_check(log: DataFrame) -> DataFrame:
    """Per package: announced count ``n`` (first counter line), parsed counter
    lines, and whether they differ."""
    p = log.select(PKG, "line_no", N.parse_progress("line").alias("p")).filter(F.col("p").isNotNull())
    return p.groupBy(PKG).agg(
        F.min_by("p.n", "line_no").alias("expected"),
        F.count(F.lit(1)).alias("parsed"),
    ).withColumn("mismatch", F.col("expected") != F.col("parsed"))


# ---------------------------------------------------------------------------
# entries → nodes → edges
def attach_paths(entries: DataFrame, n2p: DataFrame, builtin_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Resolve each kept entry to a file path by bare name within its package.

    Returns ``(resolved, unmatched)``: ``resolved`` has ``package, function,
    name, rel_path``; ``unmatched`` the kept entries whose name was not logged.
    ``builtin_only`` switches to the older filter that only drops builtins.

    A kept entry has a symbol and so a name.  Both are stated, or Spark would check
    the key of each join by working out the name once more, and readers of the
    symbols and of their number could not share the shuffled entries.
    """
    stripped = N.strip_overload_suffix("function")
    keep = not_builtin("function") if builtin_only else is_user_function(stripped)
    kept = entries.filter(keep & F.col("function").isNotNull()) \
        .select(PKG, "function", F.coalesce(N.bare_name(stripped), F.lit("")).alias("name"))
    side = n2p.select(PKG, "name", "rel_path")
    resolved = kept.join(side, [PKG, "name"])
    unmatched = kept.join(side, [PKG, "name"], "left_anti")
    return resolved, unmatched


def node_names(resolved: DataFrame, normalize_callers: bool = False) -> DataFrame:
    """``package, function, node``: unique per ``(package, function)``.

    By default the entry's own symbol keeps its ``::d`` suffix (as the original
    pipeline does), so only callees are normalised; ``normalize_callers``
    strips it from callers too.
    """
    fn = N.strip_overload_suffix("function") if normalize_callers else F.col("function")
    nodes = resolved.select(PKG, fn.alias("function"), "rel_path") \
        .filter(F.instr("function", N.MODULE_TOKEN) > 0) \
        .select(PKG, "function", N.qualified_node("rel_path", "function").alias("node"))
    # the node follows from (package, function) alone: duplicates are exact
    return nodes.distinct()


def resolve_edges(calls: DataFrame, resolved: DataFrame, normalize_callers: bool = False,
                  distinct: bool = False) -> DataFrame:
    """Edges ``package, node1, node2, type`` between resolved functions.

    The caller must be a resolved entry; each callee symbol loses its ``::d``
    suffix, must pass the user-function filter and resolve to a node, else the
    call is dropped.  Duplicate and self edges are kept unless ``distinct``.
    """
    # shuffled once by the lookup key: both lookups reuse the same exchange
    nodes = node_names(resolved, normalize_callers).repartition(PKG, "function")
    caller = N.strip_overload_suffix("caller") if normalize_callers else F.col("caller")
    callee = N.strip_overload_suffix("callee")
    c = calls.select(PKG, caller.alias("caller"), callee.alias("callee")).filter(is_user_function("callee"))
    src = nodes.select(PKG, F.col("function").alias("caller"), F.col("node").alias("node1"))
    dst = nodes.select(PKG, F.col("function").alias("callee"), F.col("node").alias("node2"))
    edges = c.join(src, [PKG, "caller"]).join(dst, [PKG, "callee"]) \
        .select(PKG, "node1", "node2", F.lit(0).alias("type"))
    return edges.distinct() if distinct else edges


def adjacency(edges: DataFrame) -> DataFrame:
    """``package, function, callees``: adjacency lists (callers without a
    resolved callee are absent, as in the original output)."""
    return edges.groupBy(PKG, F.col("node1").alias("function")).agg(F.collect_list("node2").alias("callees"))


def graph_stats(resolved: DataFrame, calls: DataFrame, builtin_only: bool = False) -> DataFrame:
    """Per package: vertices = kept entries with a path; edges = their kept callees."""
    keep = not_builtin("callee") if builtin_only else is_user_function(N.strip_overload_suffix("callee"))
    ent = resolved.select(PKG, F.col("function").alias("caller"))
    # counted by caller, as the calls are joined: both readings of the entries share their shuffles
    v = ent.groupBy(PKG).agg((F.count("caller") + F.count_if(F.col("caller").isNull())).alias("vertices"))
    e = calls.filter(keep).join(ent, [PKG, "caller"]).groupBy(PKG).agg(F.count(F.lit(1)).alias("edges"))
    return v.join(e, PKG, "left").select(PKG, "vertices", F.coalesce("edges", F.lit(0)).alias("edges"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Distinct ``package, node`` over both ends of every edge; the edges are read once."""
    return edges.select(PKG, F.explode(F.array("node1", "node2")).alias("node")).distinct()


def covered(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are extracted functions (``intersect``)."""
    return ends.intersect(nodes.select(PKG, "node"))


def uncovered(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are not extracted functions (``except``)."""
    return ends.join(nodes.select(PKG, "node"), [PKG, "node"], "left_anti")


def distinct_symbols(calls: DataFrame) -> DataFrame:
    """Distinct caller symbols per package (callees are not added, as in the
    original helper whose lazy ``map`` never ran)."""
    return calls.select(PKG, F.col("caller").alias("symbol")).distinct()


def nodes_in_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that appear as an edge end (``left_semi``)."""
    return nodes.join(edge_ends(edges), [PKG, "node"], "left_semi")


def mapping_completeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per package: distinct edge ends, functions, ends that are functions, edges.

    Edges and functions are read once each: their counts meet by ``(package, node)``
    and are added up by package.  A null node is an end but no function's, and
    nothing is counted of a null package.
    """
    ends = edges.select(PKG, F.inline(F.array(*(
        F.struct(F.col(c).alias("node"), F.lit(1).alias("_end"), F.lit(0).alias("_fn"), F.lit(e).alias("_edge"))
        for c, e in (("node1", 1), ("node2", 0))))))
    fns = nodes.select(PKG, "node", F.lit(0).alias("_end"), F.lit(1).alias("_fn"), F.lit(0).alias("_edge"))
    met = ends.unionByName(fns).groupBy(PKG, "node").agg(
        F.max("_end").alias("_end"), F.sum("_fn").alias("_fn"), F.sum("_edge").alias("_edge"))
    both = F.col("node").isNotNull() & (F.col("_end") > 0) & (F.col("_fn") > 0)
    out = met.groupBy(PKG).agg(
        F.sum("_end").alias("edge_ends"), F.sum("_fn").alias("functions"), F.count_if(both).alias("intersection"),
        F.sum("_edge").alias("edges"))
    return out.select(PKG, *[F.when(F.col(PKG).isNull(), F.lit(0)).otherwise(F.col(c)).alias(c)
                             for c in ("edge_ends", "functions", "intersection", "edges")])


def package_status(expected: DataFrame, **stages: DataFrame) -> DataFrame:
    """``package, status, reason``: a package is ``ok`` when every stage has
    output for it; otherwise the first stage without output is named."""
    out = expected.select(PKG).distinct()
    reason = F.lit(None).cast("string")
    for name, df in stages.items():
        flag = f"_has_{name}"
        out = out.join(df.select(PKG).distinct().withColumn(flag, F.lit(True)), PKG, "left")
    for name in reversed(list(stages)):
        reason = F.when(F.col(f"_has_{name}").isNull(), F.lit(f"no {name}")).otherwise(reason)
    out = out.withColumn("reason", reason)
    return out.select(PKG, F.when(F.col("reason").isNull(), "ok").otherwise("error").alias("status"), "reason")


def flatten_adjacency(adj: DataFrame) -> DataFrame:
    """``[caller, [callees]]`` rows to ``node1, node2, type=0``."""
    return adj.select(PKG, F.col("function").alias("node1"), F.explode("callees").alias("node2"), F.lit(0).alias("type"))
