"""DuckDB expressions and CTE texts shared by oracle queries.

These restate the operator rules in plain SQL (DuckDB dialect) so the oracle
is an independent formulation of the same semantics.
"""

from __future__ import annotations


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '::[0-9]$', '')"


def bare_sql(x: str) -> str:
    return f"regexp_extract({x}, '[^:]*$')"


def user_fn_sql(x: str) -> str:
    b = bare_sql(x)
    return (f"(not starts_with({b}, '$$') and not ends_with({b}, '$$') and {b} not in ('<lambda>', '<module>') "
            f"and length({b}) > 0 and not regexp_matches({b}, '^[0-9]') and not starts_with({x}, 'builtin.py'))")


def user_fn_v1_sql(x: str) -> str:
    b = bare_sql(x)
    return (f"(not starts_with({x}, '$$') and not ends_with({x}, '$$') and {b} not in ('<lambda>', '<module>') "
            f"and {b} <> '2')")


def not_builtin_sql(x: str) -> str:
    head = f"(case when instr({x}, ':') > 0 then split_part({x}, ':', 1) else left({x}, length({x}) - 1) end)"
    return f"(not contains({head}, 'builtin.py'))"


def dotted_sql(x: str) -> str:
    tail = f"(case when instr({x}, '<module>') > 0 then substr({x}, instr({x}, '<module>')) else right({x}, 1) end)"
    return f"replace(substr({tail}, instr({tail}, ':') + 1), ':', '.')"


def first_parens_sql(x: str) -> str:
    after = f"(case when instr({x}, '(') > 0 then substr({x}, instr({x}, '(') + 1) else {x} end)"
    return (f"(case when instr({after}, ')') > 0 then substr({after}, 1, instr({after}, ')') - 1) "
            f"else left({after}, length({after}) - 1) end)")


PROGRESS_RE = "'^(-?[0-9]+)/(-?[0-9]+)$'"


def log_entries_cte(log: str = "call_log", roots: str = "package_roots") -> str:
    """CTEs ending in ``log_e(package, line_no, name, rel_path)``."""
    return f"""
le0 as (select l.package, l.line_no, l.line, r.root, {first_parens_sql('l.line')} as inner_text
        from {log} l join {roots} r on r.package = l.package),
le1 as (select package, line_no, root, substr(line, instr(line, ')') + 2) as rest from le0
        where regexp_matches(inner_text, {PROGRESS_RE})),
le2 as (select package, line_no, root, rest, instr(rest, '(from ') as at_pos from le1),
le3 as (select package, line_no, root,
               substr(regexp_replace(substr(rest, 1, at_pos - 1), '^\\s+|\\s+$', '', 'g'), 5) as name,
               substr(rest, at_pos + 6) as last_part from le2 where at_pos > 0),
le4 as (select package, line_no, root, name,
               case when instr(last_part, ')') > 0 then substr(last_part, 1, instr(last_part, ')') - 1)
                    else left(last_part, length(last_part) - 1) end as full_path from le3),
log_e as (select package, line_no, name, substr(full_path, instr(full_path, root) + length(root) + 1) as rel_path
          from le4)"""


def graph_cte(normalize: bool = False, entries: str = "graph_entries", calls: str = "raw_calls",
              log: str = "call_log") -> str:
    """CTEs ending in ``edges(package, node1, node2, type)`` and friends."""
    fn = strip_sql("function") if normalize else "function"
    caller = strip_sql("caller") if normalize else "caller"
    return log_entries_cte(log) + f""",
n2p as (select package, name, max_by(rel_path, line_no) as rel_path, count(distinct rel_path) as n_paths
        from log_e group by package, name),
ent as (select package, function, {strip_sql('function')} as s from {entries}),
kept as (select package, function, {bare_sql('s')} as name from ent where {user_fn_sql('s')}),
resolved as (select k.package, k.function, k.name, n.rel_path from kept k
             join n2p n on n.package = k.package and n.name = k.name),
nodes0 as (select package, {fn} as function, rel_path from resolved),
nodes as (select package, function, max(left(rel_path, length(rel_path) - 2) || {dotted_sql('function')}) as node
          from nodes0 where instr(function, '<module>') > 0 group by package, function),
calls_c as (select package, {caller} as caller, {strip_sql('callee')} as callee from {calls}),
edges as (select c.package, a.node as node1, b.node as node2, 0 as type
          from calls_c c join nodes a on a.package = c.package and a.function = c.caller
          join nodes b on b.package = c.package and b.function = c.callee
          where {user_fn_sql('c.callee')})"""


def marked_cte(log: str = "analyzer_log") -> str:
    """CTEs ending in ``marked(package, line_no, line)``: counter lines after the
    phase marker and the header, as many as the first of them announces."""
    marker = "'Main interprocedural analysis phase...'"
    return f"""
mk as (select package, min(line_no) as m from {log} where contains(line, {marker}) group by package),
hd as (select l.package, min(l.line_no) as h from {log} l join mk on mk.package = l.package
      where l.line_no >= mk.m and ends_with(case when l.line_no = mk.m then
            substr(l.line, instr(l.line, {marker})) else l.line end,
            'functions will be analyzed.') group by l.package),
aft as (select l.* from {log} l join hd on hd.package = l.package where l.line_no > hd.h),
fst as (select package, try_cast(regexp_extract({first_parens_sql("arg_min(line, line_no)")}, {PROGRESS_RE}, 2) as bigint) as n
      from aft group by package),
cnt as (select aft.package, aft.line_no, aft.line, fst.n,
             row_number() over (partition by aft.package order by aft.line_no) as rk
      from aft join fst on fst.package = aft.package
      where fst.n is not null and regexp_matches({first_parens_sql("aft.line")}, {PROGRESS_RE})),
marked as (select package, line_no, line from cnt where rk <= n)"""
