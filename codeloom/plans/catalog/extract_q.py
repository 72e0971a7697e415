"""Queries: function / call extraction and the whole graph-building job."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.tabular import register_table_functions
from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.plans.catalog.graph_q import _edges
from codeloom.plans.catalog.sqlparts import graph_cte, marked_cte
from codeloom.plans.registry import query

# expected functions of the `src` fixture, restated by formula
_SRC_FUNCS = """
select s.package, s.path,
  concat('m', cast(s.doc_id as string), case when s.doc_id % 10 = 0 then '.C.f' else '.f' end,
         cast(s.doc_id as string)) as node,
  concat('f', cast(s.doc_id as string), case when s.doc_id % 10 = 0 then '(self, x)' else '(a, b)' end) as signature,
  case when s.doc_id % 10 = 0 then null else concat('doc ', d.lang) end as description,
  case when s.doc_id % 10 = 0
       then concat('def f', cast(s.doc_id as string), '(self, x):', chr(10), '    return f',
                   cast(s.doc_id + 20 as string), '(x)')
       else concat('def f', cast(s.doc_id as string), '(a, b=1):', chr(10), '    ', '\"\"\"doc ', d.lang, '\"\"\"',
                   chr(10), '    return f', cast(s.doc_id + 20 as string), '(a) + ', cast(d.n_chars as string)) end
    as source_code
from src s join documents d on d.doc_id = s.doc_id
where s.doc_id % 13 <> 0"""

# functions of the `graph_src` fixture, restated by formula
_GNODES = """
gk as (select o_orderkey as k from orders where o_orderkey % 23 >= 4),
gmod as (select k, k % 20 as package, concat('src', cast(k % 5 as string), '/m', cast(k % 97 as string)) as module,
                case when k % 3 = 0 then concat('C', cast(k % 7 as string), '.f', cast(k as string))
                     else concat('f', cast(k as string)) end as qualname from gk),
gnodes as (select package, module || '.' || qualname as node from gmod)"""


def _src_functions(t):
    rows = X.extract_functions(t["src"].select("package", "path", "content"), partitions=t.partitions)
    ok, bad = X.split_errors(rows)
    return X.function_nodes(ok, t["src_roots"]), bad


def _graph_nodes(t):
    rows = X.extract_functions(t["graph_src"], partitions=t.partitions)
    ok, _ = X.split_errors(rows)
    return X.function_nodes(ok, t["package_roots"])


@query("X1_extract_functions", ["src"], _SRC_FUNCS)
def x1(t):
    """One row per function of each parseable file: node, signature, docstring,
    normalised source (nested functions and async bodies per the rules)."""
    nodes, _ = _src_functions(t)
    return nodes.select("package", "path", "node", "signature", "description", "source_code")


@query("X1_table_function", ["src"], _SRC_FUNCS)
def x1_sql(t):
    """The same by SQL: a table function read laterally for every file."""
    register_table_functions(t.spark)
    rows = t.spark.sql("""select s.package, s.path, f.* from {src} s, lateral extract_functions(s.content) f
                          where f.error is null""", src=t["src"])
    return X.function_nodes(rows, t["src_roots"]).select("package", "path", "node", "signature", "description", "source_code")


@query("F7_skip_unparseable", ["src"], "select package, path from src where doc_id % 13 = 0")
def f7(t):
    """Files that do not parse are reported (and contribute no function)."""
    _, bad = _src_functions(t)
    return bad.select("package", "path")


_X7_SQL = "with " + _GNODES.strip() + """,
e as (select package, module || '.' || qualname as node1,
        case when k % 3 = 0 then module || '.' || qualname else '<unk>.len' end as a,
        case when k % 3 = 0 then '<unk>.f' || cast(k + 20 as string) else '<unk>.f' || cast(k + 20 as string) end as b,
        case when k % 3 = 0 then null else module || '.' || qualname end as c
      from gmod)
select package, node1, a as node2 from e
union all select package, node1, b from e
union all select package, node1, c from e where c is not null"""


@query("X7_find_calls", ["graph_src"], _X7_SQL)
def x7(t):
    """Edges from call expressions: local function, package function or ``<unk>.``."""
    calls = X.find_calls(t["graph_src"], partitions=t.partitions)
    nodes = _graph_nodes(t)
    return X.resolve_calls(calls, nodes, t["package_roots"])


@query("X7_table_function", ["graph_src"], _X7_SQL)
def x7_sql(t):
    """The same by SQL table functions for both the calls and the functions."""
    register_table_functions(t.spark)
    calls = t.spark.sql("select s.package, s.path, c.* from {src} s, lateral find_calls(s.content) c", src=t["graph_src"])
    nodes = t.spark.sql("select s.package, s.path, f.* from {src} s, lateral extract_functions(s.content) f", src=t["graph_src"])
    return X.resolve_calls(calls, X.function_nodes(nodes.where("error is null"), t["package_roots"]), t["package_roots"])


@query("J3_nodes_in_graph", ["graph_src", "graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + ",\n" + _GNODES.strip() + """,
ends as (select package, node1 as node from edges union select package, node2 from edges)
select g.package, g.node from gnodes g where exists (select 1 from ends e where e.package = g.package and e.node = g.node)""")
def j3(t):
    """Extracted functions that are an end of some resolved edge (semi join)."""
    return G.nodes_in_graph(_graph_nodes(t), _edges(t)).select("package", "node")


@query("U3_covered", ["graph_src", "graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + ",\n" + _GNODES.strip() + """,
ends as (select package, node1 as node from edges union select package, node2 from edges)
select package, node from ends intersect select package, node from gnodes""")
def u3c(t):
    return G.covered(G.edge_ends(_edges(t)), _graph_nodes(t))


@query("U3_uncovered", ["graph_src", "graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + ",\n" + _GNODES.strip() + """,
ends as (select package, node1 as node from edges union select package, node2 from edges)
select package, node from ends except select package, node from gnodes""")
def u3u(t):
    return G.uncovered(G.edge_ends(_edges(t)), _graph_nodes(t))


_A2_SQL = "with " + graph_cte().strip() + ",\n" + _GNODES.strip() + """,
ends as (select package, node1 as node from edges union select package, node2 from edges),
n_ends as (select package, count(*) as edge_ends from ends group by package),
n_fn as (select package, count(*) as functions from gnodes group by package),
n_int as (select package, count(*) as intersection from ends e
          where exists (select 1 from gnodes g where g.package = e.package and g.node = e.node) group by package),
n_e as (select package, count(*) as edges from edges group by package),
pk as (select package from n_ends union select package from n_fn)
select pk.package, coalesce(edge_ends, 0) as edge_ends, coalesce(functions, 0) as functions,
       coalesce(intersection, 0) as intersection, coalesce(edges, 0) as edges
from pk left join n_ends using (package) left join n_fn using (package) left join n_int using (package)
left join n_e using (package)"""


@query("A2_mapping_completeness", ["graph_src", "graph_entries", "raw_calls", "call_log", "package_roots"], _A2_SQL)
def a2(t):
    return G.mapping_completeness(_graph_nodes(t), _edges(t))


_L1_VIEWS = ["graph_src", "graph_entries", "raw_calls", "analyzer_log", "package_roots"]
_L1_SQL = ("with " + marked_cte().strip() + ",\n" + graph_cte(log="marked").strip() + ",\n" + _GNODES.strip() + """,
ends as (select package, node1 as node from edges union select package, node2 from edges),
has_log as (select distinct package from log_e),
has_nodes as (select distinct package from gnodes),
has_edges as (select distinct package from edges)
select package, 'edge' as kind, node1 as a, node2 as b from edges
union all select g.package, 'node', g.node, null from gnodes g
          where exists (select 1 from ends e where e.package = g.package and e.node = g.node)
union all select r.package, 'status',
       case when l.package is null or n.package is null or e.package is null then 'error' else 'ok' end,
       case when l.package is null then 'no log' when n.package is null then 'no nodes'
            when e.package is null then 'no edges' end
from package_roots r left join has_log l on l.package = r.package left join has_nodes n on n.package = r.package
left join has_edges e on e.package = r.package""")


@query("L1_build_graph", _L1_VIEWS, _L1_SQL)
def l1(t):
    """Whole graph job for all packages: the edges, the nodes on an edge and
    each package's status."""
    from codeloom.plans.graph_build import build_graph

    g = build_graph(t["graph_src"], t["graph_entries"], t["raw_calls"], t["analyzer_log"], t["package_roots"],
                    partitions=t.partitions)
    row = lambda df, kind, a, b: df.select("package", F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"))
    return row(g["edges"], "edge", "node1", F.col("node2")) \
        .union(row(g["nodes"], "node", "node", F.lit(None).cast("string"))) \
        .union(row(g["status"], "status", "status", F.col("reason")))


@query("L1_update_graph", _L1_VIEWS, _L1_SQL + """
union all select package, 'run', case when package < 10 then '1' else '2' end, null from package_roots""")
def l1_update(t):
    """The same in two runs: packages below 10 first, then all, of which the second run builds those still pending."""
    import uuid

    from codeloom.plans import incremental as I
    from codeloom.session import ensure_checkpoint_dir

    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    tables = {"src": "graph_src", "entries": "graph_entries", "calls": "raw_calls", "log": "analyzer_log", "roots": "package_roots"}
    inputs = {k: t[v] for k, v in tables.items()}
    versions = t["package_roots"].select("package", F.lit("1").alias("version"))
    kind = versions.schema["package"].dataType.simpleString()
    I.update_graph(t.spark, root, versions.where("package < 10"), inputs, partitions=t.partitions)
    I.update_graph(t.spark, root, versions, inputs, partitions=t.partitions)
    null = F.lit(None).cast("string")
    row = lambda df, what, a, b: df.select("package", F.lit(what).alias("kind"), a.alias("a"), b.alias("b"))
    out = {name: I.read_output(t.spark, root, name, kind) for name in ("edges", "nodes", "status")}
    return row(out["edges"], "edge", F.col("node1"), F.col("node2")).union(row(out["nodes"], "node", F.col("node"), null)) \
        .union(row(out["status"], "status", F.col("status"), F.col("reason"))) \
        .union(row(I.read_manifest(t.spark, root, kind), "run", F.col("run").cast("string"), null))


@query("F8_package_status", ["graph_src", "graph_entries", "raw_calls", "call_log", "package_roots"],
       "with " + graph_cte().strip() + """,
has_log as (select distinct package from log_e),
has_edges as (select distinct package from edges)
select r.package, case when l.package is null or e.package is null then 'error' else 'ok' end as status,
       case when l.package is null then 'no log' when e.package is null then 'no edges' end as reason
from package_roots r left join has_log l on l.package = r.package left join has_edges e on e.package = r.package""")
def f8(t):
    """Per package: ok, or the first stage that produced nothing."""
    log = G.log_entries(t["call_log"], t["package_roots"])
    return G.package_status(t["package_roots"], log=log, edges=_edges(t))


@query("X2_qualified_name", ["src"],
       "select package, path, node from (" + _SRC_FUNCS + ") t")
def x2(t):
    """``Class.fn`` or ``fn`` (innermost class), prefixed by the module path."""
    nodes, _ = _src_functions(t)
    return nodes.select("package", "path", "node")


@query("X3_signature", ["src"], "select package, path, signature from (" + _SRC_FUNCS + ") t")
def x3(t):
    """``name(a, b)``: ordinary arguments only."""
    nodes, _ = _src_functions(t)
    return nodes.select("package", "path", "signature")


@query("X4_docstring", ["src"], "select package, path, description from (" + _SRC_FUNCS + ") t")
def x4(t):
    """First string statement of the body, else null."""
    nodes, _ = _src_functions(t)
    return nodes.select("package", "path", "description")


@query("X5_normalised_source", ["src"], "select package, path, source_code from (" + _SRC_FUNCS + ") t")
def x5(t):
    """Source re-printed from the tree (comments gone, docstring kept)."""
    nodes, _ = _src_functions(t)
    return nodes.select("package", "path", "source_code")


@query("X6_reach", ["nested_src"],
       """select package, path, 'inner' || regexp_extract(path, 'n([0-9]+)[.]py$', 1) as qualname,
  'inner' || regexp_extract(path, 'n([0-9]+)[.]py$', 1) || '(x)' as signature, cast(null as varchar) as description
from nested_src
union all select package, path, 'outer' || regexp_extract(path, 'n([0-9]+)[.]py$', 1),
  'outer' || regexp_extract(path, 'n([0-9]+)[.]py$', 1) || '(q)', null from nested_src
union all select package, path, 'Deep.d', 'd(self)', null from nested_src
union all select package, path, 'after', 'after(self)', d.lang
from nested_src n join documents d on n.path = d.source || '/n' || cast(d.doc_id as string) || '.py'""")
def x6(t):
    """Nested functions are not listed, ``async def`` is not listed but the
    sync function inside it is, the class is forgotten after an inner class."""
    rows, _ = X.split_errors(X.extract_functions(t["nested_src"], partitions=t.partitions))
    return rows.select("package", "path", "qualname", "signature", "description")
