"""Call-graph operators: marker filter, last-wins lookup, edge resolution."""

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators.ranking import running_rank
from codeloom.sources.tables import Tables
from conftest import SF_MID, SF_SMALL


def _log(spark, lines, pkg="p"):
    return spark.createDataFrame([(pkg, i, l) for i, l in enumerate(lines)], "package string, line_no long, line string")


def test_after_marker_cuts_at_announced_count(spark):
    lines = [
        "prep (1/3) noise before the marker",
        "x Main interprocedural analysis phase...",
        "2 functions will be analyzed.",
        "[I] (1/2) \x1b[0mf (from /r/p/a.py)",
        "something without counter",
        "[I] (2/2) \x1b[0mg (from /r/p/b.py)",
        "[I] (3/2) \x1b[0mh (from /r/p/c.py)",
    ]
    out = G.after_marker(_log(spark, lines)).orderBy("line_no").collect()
    assert [r["line_no"] for r in out] == [3, 5]


def test_after_marker_without_header_yields_nothing(spark):
    out = G.after_marker(_log(spark, ["Main interprocedural analysis phase...", "(1/1) f (from /r/p/a.py)"]))
    assert out.count() == 0


def test_log_entries_last_wins(spark):
    log = _log(spark, ["(1/3) \x1b[0mf (from /r/p/a.py)", "(2/3) \x1b[0mg (from /r/p/b.py)",
                       "(3/3) \x1b[0mf (from /r/p/z.py)"])
    roots = spark.createDataFrame([("p", "/r/p")], "package string, root string")
    entries = G.log_entries(log, roots)
    n2p = {r["name"]: r["rel_path"] for r in G.name_to_path(entries).collect()}
    assert n2p == {"f": "z.py", "g": "b.py"}
    assert [(r["name"], r["n_paths"]) for r in G.ambiguous_names(entries).collect()] == [("f", 2)]


def _graph(spark):
    entries = spark.createDataFrame(
        [("p", "a.py:<module>:f"), ("p", "a.py:<module>:g::1"), ("p", "a.py:<module>:C:h"),
         ("p", "a.py:<module>:<lambda>"), ("p", "builtin.py:<module>:len"), ("p", "a.py:<module>:lonely")],
        "package string, function string")
    calls = spark.createDataFrame(
        [("p", "a.py:<module>:f", "a.py:<module>:f"), ("p", "a.py:<module>:f", "a.py:<module>:g::1"),
         ("p", "a.py:<module>:f", "a.py:<module>:g::1"), ("p", "a.py:<module>:f", "builtin.py:<module>:len"),
         ("p", "a.py:<module>:C:h", "a.py:<module>:f::2"), ("p", "a.py:<module>:g::1", "a.py:<module>:f"),
         ("p", "a.py:<module>:lonely", "a.py:<module>:unknown")],
        "package string, caller string, callee string")
    n2p = spark.createDataFrame([("p", n, "src/a.py") for n in ["f", "g", "h", "lonely"]],
                                "package string, name string, rel_path string")
    return entries, calls, n2p


def test_resolve_edges_faithful_and_normalized(spark):
    entries, calls, n2p = _graph(spark)
    resolved, unmatched = G.attach_paths(entries, n2p)
    assert unmatched.count() == 0
    faithful = sorted((r["node1"], r["node2"]) for r in G.resolve_edges(calls, resolved).collect())
    # the callee g::1 is looked up as "g", which is not an entry symbol: dropped;
    # duplicate and self edges are kept; the caller g::1 keeps its suffix
    assert faithful == sorted([
        ("src/a.f", "src/a.f"), ("src/a.C.h", "src/a.f"), ("src/a.g..1", "src/a.f"),
    ])
    norm = sorted((r["node1"], r["node2"]) for r in G.resolve_edges(calls, resolved, normalize_callers=True).collect())
    assert norm == sorted([
        ("src/a.f", "src/a.f"), ("src/a.f", "src/a.g"), ("src/a.f", "src/a.g"),
        ("src/a.C.h", "src/a.f"), ("src/a.g", "src/a.f"),
    ])
    stats = G.graph_stats(resolved, calls).first()
    assert (stats["vertices"], stats["edges"]) == (4, 6)


def _edge_count(spark, sf, normalize):
    # small fixture: the first 2,000 order keys, for which the counts were recorded
    small = {
        "orders": spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey < 2000"),
        "lineitem": spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey < 2000"),
    }
    t = Tables(spark, sf, overrides=small)
    resolved, _ = G.attach_paths(t["graph_entries"], G.name_to_path(G.log_entries(t["call_log"], t["package_roots"])))
    return G.resolve_edges(t["raw_calls"], resolved, normalize_callers=normalize).count()


def test_resolved_edge_counts_on_fixture(spark):
    # counts recorded for these fixtures (faithful / normalised callers)
    assert _edge_count(spark, SF_SMALL, False) == 3040
    assert _edge_count(spark, SF_SMALL, True) == 3338
    assert _edge_count(spark, SF_MID, False) == 4182
    assert _edge_count(spark, SF_MID, True) == 4513


def test_mapping_completeness_and_semi_join(spark):
    edges = spark.createDataFrame([("p", "a", "b", 0), ("p", "a", "x", 0)], "package string, node1 string, node2 string, type int")
    nodes = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("p", "c")], "package string, node string")
    r = G.mapping_completeness(nodes, edges).first()
    assert (r["edge_ends"], r["functions"], r["intersection"], r["edges"]) == (3, 4, 2, 2)
    kept = sorted(x["node"] for x in G.nodes_in_graph(nodes, edges).collect())
    assert kept == ["a", "b"]
    assert sorted(x["node"] for x in G.uncovered(G.edge_ends(edges), nodes).collect()) == ["x"]


def test_running_rank_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 10007).alias("x"))
    ranked = running_rank(df, ["g"], "x", width=64)
    from pyspark.sql import Window

    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("x")))
    diff = ranked.join(ref, ["g", "x"]).filter(F.col("_rank") != F.col("rn")).count()
    assert diff == 0 and ranked.count() == 5000


def test_package_status(spark):
    roots = spark.createDataFrame([("a",), ("b",), ("c",)], "package string")
    log = spark.createDataFrame([("a",), ("b",)], "package string")
    edges = spark.createDataFrame([("a",)], "package string")
    st = {r["package"]: (r["status"], r["reason"]) for r in G.package_status(roots, log=log, edges=edges).collect()}
    assert st == {"a": ("ok", None), "b": ("error", "no edges"), "c": ("error", "no log")}


def test_log_of_dealt_parts_is_read(spark):
    """A log whose parts are dealt by package when planned, and broadcast when run, is joined all the same."""
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"))
    t = Tables(spark, "none", {"orders": orders})
    dealt = t["call_lines"].groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    lines = t["call_lines"].join(dealt, "package").select(
        "package", "line_no", F.concat(F.lit("[INFO] ("), "i", F.lit("/"), "n", F.lit(") "), "entry").alias("line"))
    packages = lines.select("package").distinct()
    log = lines.unionByName(packages.select("package", F.lit(-2).alias("line_no"), F.lit("Main interprocedural analysis phase...").alias("line"))) \
        .unionByName(packages.select("package", F.lit(-1).alias("line_no"), F.lit("50 functions will be analyzed.").alias("line")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        kept = G.after_marker(log)
        assert kept.count() == lines.count() and G.phase_flag(log).where("after_marker").count() == lines.count() + 20
        assert G.after_marker(t["analyzer_log"]).groupBy("package").count().count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_and_functions_are_read_once(spark):
    edges = spark.range(0, 50, 1, 2).select((F.col("id") % 3).alias("package"), F.concat(F.lit("a"), "id").alias("node1"),
                                            F.concat(F.lit("b"), "id").alias("node2"), F.lit(0).alias("type"))
    nodes = spark.range(0, 70, 1, 2).select((F.col("id") % 3).alias("package"), F.concat(F.lit("a"), "id").alias("node"))
    assert _plan(G.edge_ends(edges)).count("Range (0, 50") == 1
    done = _plan(G.mapping_completeness(nodes, edges))
    assert (done.count("Range (0, 50"), done.count("Range (0, 70")) == (1, 1)
    assert {tuple(r) for r in G.mapping_completeness(nodes, edges).collect()} == {(0, 34, 24, 17, 17), (1, 34, 23, 17, 17), (2, 32, 23, 16, 16)}


def test_completeness_of_nulls_and_duplicates(spark):
    edges = spark.createDataFrame([("p", "x", "y"), ("p", "x", "y"), ("p", None, "x"), (None, "x", "y"), ("q", "x", None)],
                                  "package string, node1 string, node2 string")
    nodes = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", None), ("r", "x"), (None, "x")], "package string, node string")
    rows = {r["package"]: tuple(r)[1:] for r in G.mapping_completeness(nodes, edges).collect()}
    # a null node is an end and a function, but never both; packages are joined, so a null one has no counts
    assert rows == {"p": (3, 3, 1, 3), "q": (2, 0, 0, 1), "r": (0, 1, 0, 0), None: (0, 0, 0, 0)}
    assert {tuple(r) for r in G.edge_ends(edges).collect()} == {("p", "x"), ("p", "y"), ("p", None), (None, "x"), (None, "y"), ("q", "x"), ("q", None)}


def test_stats_read_the_entries_once(spark):
    """Entries are read, filtered and shuffled once for both counts, and a logged name is stripped once."""
    symbol = F.when(F.col("id") >= 0, F.concat(F.lit("m.py:<module>:f"), "id"))  # may be null, as what is read from files
    entries = spark.range(0, 50, 1, 2).select((F.col("id") % 3).alias("package"), symbol.alias("function"))
    log = spark.range(0, 70, 1, 2).select((F.col("id") % 3).alias("package"), F.col("id").alias("line_no"), F.concat(
        F.lit("[INFO] ("), F.col("id").cast("string"), F.lit("/70) \x1b[0mf"), F.col("id").cast("string"), F.lit(" (from /w/m.py)")).alias("line"))
    calls = spark.range(0, 90, 1, 2).select((F.col("id") % 3).alias("package"), F.concat(F.lit("m.py:<module>:f"), F.col("id") % 60).alias("caller"),
                                            F.lit("m.py:<module>:f1::1").alias("callee"))
    roots = spark.createDataFrame([(k, "/w") for k in range(3)], "package long, root string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        resolved, _ = G.attach_paths(entries, G.name_to_path(G.log_entries(log, roots)))
        stats = G.graph_stats(resolved, calls)
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Range (0, 50"), plan.count("Range (0, 70"), plan.count("^\\s+|\\s+$")) == (1, 1, 1)
        assert {tuple(r) for r in stats.collect()} == {(0, 17, 27), (1, 17, 27), (2, 16, 26)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stats_of_nulls_and_duplicates(spark):
    resolved = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", None), ("p", "b"), ("q", "c"), (None, "a"), (None, None)],
                                     "package string, function string")
    calls = spark.createDataFrame([("p", "a", "m:f"), ("p", "a", "m:f"), ("p", "b", "m:<lambda>"), ("p", None, "m:f"), (None, "a", "m:f"),
                                   ("r", "a", "m:f"), ("p", "b", None)], "package string, caller string, callee string")
    assert {tuple(r) for r in G.graph_stats(resolved, calls).collect()} == {("p", 4, 4), ("q", 1, 0), (None, 2, 0)}
    entries = spark.createDataFrame([("p", None), ("p", "m:f"), ("p", "m:f"), ("p", "m:g::1"), (None, "m:f"), ("p", "")], "package string, function string")
    n2p = spark.createDataFrame([("p", "f", "x.py"), ("p", None, "y.py"), ("p", "", "z.py"), (None, "f", "x.py")], "package string, name string, rel_path string")
    found, missing = G.attach_paths(entries, n2p)
    assert [tuple(r) for r in found.select("package", "function", "name").collect()] == [("p", "m:f", "f")] * 2
    assert {tuple(r) for r in missing.select("package", "function", "name").collect()} == {("p", "m:g::1", "g"), (None, "m:f", "f")}
    lines = spark.createDataFrame([("p", 1, "[INFO] (1/3) \x1b[0m (from /w/a.py)"), ("p", 2, None), ("p", 3, "[INFO] (2/3) none")],
                                  "package string, line_no long, line string")
    logged = G.log_entries(lines, spark.createDataFrame([("p", "/w")], "package string, root string")).collect()
    assert [tuple(r) for r in logged] == [("p", 1, "", "a.py")]
