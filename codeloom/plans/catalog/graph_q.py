"""Queries: symbol cleaning, analyzer-log parsing and call-graph resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions import predicates as P
from codeloom.operators import graph as G
from codeloom.plans.catalog.sqlparts import (
    PROGRESS_RE, bare_sql, dotted_sql, first_parens_sql, graph_cte, log_entries_cte, marked_cte, not_builtin_sql,
    strip_sql, user_fn_sql, user_fn_v1_sql,
)
from codeloom.plans.registry import query
from codeloom.sources import readers as R


def _resolved(t):
    entries = G.log_entries(t["call_log"], t["package_roots"])
    n2p = G.name_to_path(entries)
    return G.attach_paths(t["graph_entries"], n2p)


def _edges(t, normalize=False):
    resolved, _ = _resolved(t)
    return G.resolve_edges(t["raw_calls"], resolved, normalize_callers=normalize)


# --- P1-P9: symbol and log-line functions --------------------------------------------
@query("P1_strip_overload_suffix", ["raw_names"],
       f"select k, symbol, {strip_sql('symbol')} as stripped from raw_names")
def p1(t):
    return t["raw_names"].select("k", "symbol", N.strip_overload_suffix("symbol").alias("stripped"))


@query("P2_bare_name", ["raw_names"], f"select k, {bare_sql('symbol')} as name from raw_names")
def p2(t):
    return t["raw_names"].select("k", N.bare_name("symbol").alias("name"))


@query("P3_readable_name", ["raw_names"],
       "select k, regexp_replace(symbol, '^[^.]*\\.', '') as readable from raw_names")
def p3(t):
    return t["raw_names"].select("k", N.readable_name("symbol").alias("readable"))


@query("P4_dotted_name", ["raw_names"], f"select k, {dotted_sql('symbol')} as dotted from raw_names")
def p4(t):
    return t["raw_names"].select("k", N.dotted_name("symbol").alias("dotted"))


@query("P5_qualified_node", ["graph_entries", "call_log", "package_roots"],
       "with " + graph_cte().strip() + "\nselect package, function, node from nodes")
def p5(t):
    resolved, _ = _resolved(t)
    return G.node_names(resolved)


@query("P6_local_module", ["graph_src", "package_roots"],
       """select g.package, g.path, substr(g.path, length(r.root) + 2, length(g.path) - length(r.root) - 4) as module
from graph_src g join package_roots r on r.package = g.package""")
def p6(t):
    g = t["graph_src"].join(t["package_roots"], "package")
    return g.select("package", "path", N.local_module("path", F.col("root")).alias("module"))


@query("P7_parse_progress", ["call_log"],
       f"""select package, line_no,
  try_cast(regexp_extract({first_parens_sql('line')}, {PROGRESS_RE}, 1) as bigint) as i,
  try_cast(regexp_extract({first_parens_sql('line')}, {PROGRESS_RE}, 2) as bigint) as n
from call_log where regexp_matches({first_parens_sql('line')}, {PROGRESS_RE})""")
def p7(t):
    p = t["call_log"].select("package", "line_no", N.parse_progress("line").alias("p"))
    return p.filter(F.col("p").isNotNull()).select("package", "line_no", "p.i", "p.n")


@query("P8_is_number", ["call_log"],
       """select package, line_no,
  regexp_matches(split_part(split_part(line, '(', 2), '/', 1), '^-?[0-9]+(\\.[0-9]+)?$') as count_is_number,
  regexp_matches(split_part(split_part(line, ' ', 3), 'm', 2), '^-?[0-9]+(\\.[0-9]+)?$') as name_is_number
from call_log""")
def p8(t):
    log = t["call_log"]
    a = F.split_part(F.split_part("line", F.lit("("), F.lit(2)), F.lit("/"), F.lit(1))
    b = F.split_part(F.split_part("line", F.lit(" "), F.lit(3)), F.lit("m"), F.lit(2))
    return log.select("package", "line_no", N.is_number(a).alias("count_is_number"),
                      N.is_number(b).alias("name_is_number"))


@query("P9_parse_log_entry", ["call_log", "package_roots"],
       "with " + log_entries_cte().strip() + "\nselect package, line_no, name, rel_path from log_e")
def p9(t):
    return G.log_entries(t["call_log"], t["package_roots"])


# --- F1-F6: filters -------------------------------------------------------------------
@query("F1_is_user_function", ["raw_names"],
       f"select k, symbol, {user_fn_sql(strip_sql('symbol'))} as keep from raw_names")
def f1(t):
    return t["raw_names"].select("k", "symbol", P.is_user_function(N.strip_overload_suffix("symbol")).alias("keep"))


@query("F2_is_user_function_v1", ["raw_names"], f"select k, {user_fn_v1_sql('symbol')} as keep from raw_names")
def f2(t):
    return t["raw_names"].select("k", P.is_user_function_v1("symbol").alias("keep"))


@query("F3_not_builtin", ["raw_names"],
       f"select k, {not_builtin_sql('symbol')} as keep, {not_builtin_sql(bare_sql('symbol'))} as keep_bare "
       "from raw_names")
def f3(t):
    return t["raw_names"].select("k", P.not_builtin("symbol").alias("keep"),
                                 P.not_builtin(N.bare_name("symbol")).alias("keep_bare"))


@query("F4_filter_callees", ["raw_calls"],
       f"""select package, caller, count(*) as n_callees,
  count(*) filter (where {user_fn_sql(strip_sql('callee'))}) as n_kept
from raw_calls group by package, caller""")
def f4(t):
    """Strip the suffix of each callee and keep user functions, counted per caller (one row per call, no lists)."""
    callee = N.strip_overload_suffix("callee")
    return t["raw_calls"].groupBy("package", "caller").agg(
        F.count(F.lit(1)).alias("n_callees"), F.count_if(P.is_user_function(callee)).alias("n_kept"))


@query("F5_drop_isolated", ["graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + "\nselect distinct package, node1 as node from edges")
def f5(t):
    """Callers that keep at least one resolved callee (the others are dropped)."""
    return _edges(t).select("package", F.col("node1").alias("node")).distinct()


@query("F6_after_marker", ["analyzer_log"],
       "with " + marked_cte().strip() + "\nselect package, line_no, line from marked")
def f6(t):
    return G.after_marker(t["analyzer_log"])


@query("W5_phase_flag", ["analyzer_log"],
       """select l.package, l.line_no, coalesce(l.line_no > m.m, false) as after_marker
from analyzer_log l left join (select package, min(line_no) as m from analyzer_log
  where contains(line, 'Main interprocedural analysis phase...') group by package) m on m.package = l.package""")
def w5(t):
    """Lines after the package's phase marker."""
    return G.phase_flag(t["analyzer_log"]).select("package", "line_no", "after_marker")


# --- joins, aggregates and set operations over the graph ------------------------------
@query("A3_last_wins", ["call_log", "package_roots"],
       "with " + log_entries_cte().strip() +
       "\nselect package, name, max_by(rel_path, line_no) as rel_path from log_e group by package, name")
def a3(t):
    entries = G.log_entries(t["call_log"], t["package_roots"])
    return G.last_wins(entries, ["package", "name"], "rel_path", "line_no")


@query("J1_attach_paths", ["graph_entries", "call_log", "package_roots"],
       "with " + graph_cte().strip() + "\nselect package, function, name, rel_path from resolved")
def j1(t):
    resolved, _ = _resolved(t)
    return resolved.select("package", "function", "name", "rel_path")


@query("J1_unmatched_report", ["graph_entries", "call_log", "package_roots"],
       "with " + graph_cte().strip() +
       "\nselect package, function, name from kept k where not exists "
       "(select 1 from n2p n where n.package = k.package and n.name = k.name)")
def j1_report(t):
    _, unmatched = _resolved(t)
    return unmatched.select("package", "function", "name")


@query("J2_resolve_callees", ["graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + "\nselect package, node1, node2, type from edges")
def j2(t):
    """Edges with the caller's own ``::d`` suffix kept (faithful)."""
    return _edges(t)


@query("J2_resolve_callees_normalized", ["graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte(normalize=True).strip() + "\nselect package, node1, node2, type from edges")
def j2n(t):
    """Edges with ``::d`` stripped from callers too."""
    return _edges(t, normalize=True)


@query("A1_graph_stats", ["graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + f""",
v as (select package, count(*) as vertices from resolved group by package),
e as (select c.package, count(*) as edges from raw_calls c join resolved r
      on r.package = c.package and r.function = c.caller
      where {user_fn_sql(strip_sql('c.callee'))} group by c.package)
select v.package, v.vertices, coalesce(e.edges, 0) as edges from v left join e on e.package = v.package""")
def a1(t):
    resolved, _ = _resolved(t)
    return G.graph_stats(resolved, t["raw_calls"])


@query("U2_edge_ends", ["graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() +
       "\nselect package, node1 as node from edges union select package, node2 from edges")
def u2(t):
    return G.edge_ends(_edges(t))


@query("U4_distinct_symbols", ["raw_calls"], "select distinct package, caller as symbol from raw_calls")
def u4(t):
    return G.distinct_symbols(t["raw_calls"])


@query("A6_log_count_check", ["call_log"],
       f"""with p as (select package, line_no,
  try_cast(regexp_extract({first_parens_sql('line')}, {PROGRESS_RE}, 2) as bigint) as n
  from call_log where regexp_matches({first_parens_sql('line')}, {PROGRESS_RE}))
select package, arg_min(n, line_no) as expected, count(*) as parsed, arg_min(n, line_no) <> count(*) as mismatch
from p group by package""")
def a6(t):
    return G.log_count_check(t["call_log"])


@query("S10_pending_packages", ["package_roots", "call_log"],
       f"""with p as (select package, line_no,
  try_cast(regexp_extract({first_parens_sql('line')}, {PROGRESS_RE}, 2) as bigint) as n
  from call_log where regexp_matches({first_parens_sql('line')}, {PROGRESS_RE})),
done as (select package from p group by package having arg_min(n, line_no) = count(*))
select package, root from package_roots r where not exists (select 1 from done d where d.package = r.package)""")
def s10(t):
    """Packages whose analyzer output is absent or incomplete (to be re-run)."""
    done = G.log_count_check(t["call_log"]).filter(~F.col("mismatch")).select("package")
    return R.pending_packages(t["package_roots"], done)
