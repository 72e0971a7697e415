"""Given parquet tables and the code-shaped views derived from them.

The test tables are TPC-H-like and contain no Python code, call graphs or
analyzer logs, so the code-shaped inputs of our operators are *derived by Spark
from the given tables* with the SQL below.  The same text, with plain table
names, is the head (a ``WITH`` list) of every DuckDB oracle query, so both
engines see identical inputs and the check is about the operator only.

Each view body uses ``{name}`` placeholders for the relations it reads; Spark
binds them to DataFrames through ``spark.sql(text, **frames)`` and the oracle
formats them to plain view names.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Fixed view definitions (the code-shaped fixtures of FIXTURES.md section 3).
VIEW_SQL: dict[str, str] = {
    # one symbol per caller key k (every order key)
    "raw_names": """
select k, concat(
  case when k % 17 = 0 then 'builtin.py' else concat('m', cast(k % 97 as string), '.py') end, ':<module>',
  case when k % 3 = 0 then concat(':C', cast(k % 7 as string)) else '' end, ':',
  case k % 23 when 0 then '<lambda>' when 1 then '$$init$$' when 2 then '2' when 3 then '<module>'
              else concat('f', cast(k as string)) end,
  case when k % 13 = 0 then '::1' else '' end) as symbol
from (select o_orderkey as k from {orders}) t""",
    # one row per call; callee key ck lies in the caller's package (k % 20)
    "raw_calls": """
select c.k % 20 as package, a.symbol as caller, c.pos, b.symbol as callee
from (select l_orderkey as k, l_linenumber as pos,
             (l_partkey - l_partkey % 20) + l_orderkey % 20 as ck
      from {lineitem}) c
join {raw_names} a on a.k = c.k join {raw_names} b on b.k = c.ck""",
    # call-graph entries: distinct (package, symbol); callee list may be empty
    "graph_entries": """
select distinct k % 20 as package, symbol as function from {raw_names}""",
    # what the analyzer logs, in order; some names missing, some twice (last wins)
    "call_lines": """
select k % 20 as package, 2 * k as line_no, k + 1 as i, concat('f', cast(k as string), ' (from /w/pkg',
         cast(k % 20 as string), '/src', cast(k % 5 as string), '/m', cast(k % 97 as string), '.py)') as entry
from (select o_orderkey as k from {orders} where o_orderkey % 29 <> 0) t
union all
select k % 20, 2 * k + 1, k + 1, concat('f', cast(k as string), ' (from /w/pkg', cast(k % 20 as string), '/alt/m.py)')
from (select o_orderkey as k from {orders}
      where o_orderkey % 31 = 0 and o_orderkey % 29 <> 0) t""",
    # counter lines: even packages announce as many as there are, odd ones three fewer
    "call_log": """
select l.package, l.line_no, concat('[INFO] (', cast(l.i as string), '/',
    cast(case when l.package % 2 = 0 then s.n else s.n - 3 end as string), ') ', chr(27), '[0m', l.entry) as line
from {call_lines} l join (select package, count(*) as n from {call_lines} group by package) s on s.package = l.package""",
    # package roots as they appear in the log
    "package_roots": """
select distinct k % 20 as package, concat('/w/pkg', cast(k % 20 as string)) as root
from (select o_orderkey as k from {orders}) t""",
    # the analyzer log with its phase marker, header and a counter-shaped line
    # before the marker (which must be ignored), for the marker/count filter
    "analyzer_log": """
select package, line_no, line from {call_log}
union all
select package, -3, '[INFO] (1/5) preprocessing' from (select distinct package from {call_log}) p
union all
select package, -2, 'Main interprocedural analysis phase...' from (select distinct package from {call_log}) p
union all
select package, -1, concat(cast(package * 10 + 50 as string), ' functions will be analyzed.')
from (select distinct package from {call_log}) p""",
    # package source files matching the call graph: one function per key k,
    # a method of class C<k % 7> when k % 3 = 0 (root folder /w/pkg<p>); each
    # calls itself, a function of another key and a builtin or a method
    "graph_src": """
select k % 20 as package,
  concat('/w/pkg', cast(k % 20 as string), '/src', cast(k % 5 as string), '/m', cast(k % 97 as string), '.py') as path,
  case when k % 3 = 0
       then concat('class C', cast(k % 7 as string), ':', chr(10), '    def f', cast(k as string), '(self, x):',
                   chr(10), '        return self.f', cast(k as string), '(x) + f', cast(k + 20 as string), '(x)', chr(10))
       else concat('def f', cast(k as string), '(a, b=2):', chr(10), '    return f', cast(k + 20 as string),
                   '(a) + len(b) + f', cast(k as string), '(a - 1)', chr(10)) end as content
from (select o_orderkey as k from {orders} where o_orderkey % 23 >= 4) t""",
    # package roots of the source-file fixture (one folder per document source)
    "src_roots": """
select distinct source as package, source as root from {documents}""",
    # files with nested, async and class-scoped definitions (reach rules)
    "nested_src": """
select source as package, concat(source, '/n', cast(doc_id as string), '.py') as path,
  concat('async def a', cast(doc_id as string), '():', chr(10),
         '    def inner', cast(doc_id as string), '(x, *args, y=1, **kw):', chr(10),
         '        return x', chr(10),
         '    return inner', cast(doc_id as string), '(1)', chr(10), chr(10),
         'def outer', cast(doc_id as string), '(p, /, q):', chr(10),
         '    def hidden():', chr(10), '        pass', chr(10),
         '    return hidden', chr(10), chr(10),
         'class K', cast(doc_id % 7 as string), ':', chr(10),
         '    class Deep:', chr(10), '        def d(self):', chr(10), '            pass', chr(10),
         '    def after(self):', chr(10), '        ', chr(34), chr(34), chr(34), lang, chr(34), chr(34), chr(34),
         chr(10)) as content
from {documents}""",
    # source files; every 13th unparseable, every 10th a method of class C
    "src": """
select source as package, doc_id, concat(source, '/m', cast(doc_id as string), '.py') as path,
  case when doc_id % 13 = 0 then 'def ('
       when doc_id % 10 = 0 then concat('class C:', chr(10), '    def f', cast(doc_id as string), '(self, x):',
            chr(10), '        return f', cast(doc_id + 20 as string), '(x)', chr(10))
       else concat('def f', cast(doc_id as string), '(a, b=1):', chr(10), '    ', chr(39), 'doc ', lang, chr(39),
            chr(10), '    # note', chr(10), '    return f', cast(doc_id + 20 as string), '(a) + ',
            cast(n_chars as string), chr(10)) end as content
from {documents}""",
    # a graph over documents: each node points to the next of its package
    "node_docs": """
select source as package, doc_id, concat(source, '/m.f', cast(doc_id as string)) as node,
  case when doc_id % 19 = 0 then cast(null as string) else text end as source_code,
  row_number() over (partition by source order by doc_id) as idx,
  count(*) over (partition by source) as n
from {documents}""",
    "edge_docs": """
select a.package, a.doc_id as edge_id, a.node as node1,
  case when a.idx % 10 = 0 then concat('<unk>.g', cast(a.doc_id as string)) else b.node end as node2, 0 as type
from {node_docs} a join {node_docs} b on a.package = b.package and b.idx = a.idx % a.n + 1""",
    # functions of every document, without vectors
    "code_base": """
select source as dataset_name, doc_id as id, concat('f', cast(doc_id as string), '(a, b)') as signature,
  lang as comment, text as raw_source_code
from {documents}""",
    # retrieval input: every document with a vector; the vectors (numbered from
    # 0) are dealt in turn, so documents a multiple of their number apart share one
    "function_base": """
select c.dataset_name, c.id, c.signature, c.comment, c.raw_source_code, e.embedding
from (select *, id % (select count(*) from {embeddings}) as turn from {code_base}) c
join {embeddings} e on e.vec_id = c.turn""",
    # anchor / positive / negative ids inside 10 groups
    "triplet_vectors": """
with v as (select vec_id, vec_id % 10 as package,
                  row_number() over (partition by vec_id % 10 order by vec_id) as idx,
                  count(*) over (partition by vec_id % 10) as n, embedding from {embeddings})
select a.package, a.vec_id as anchor, b.vec_id as positive, c.vec_id as negative,
       a.embedding as e1, b.embedding as e2, c.embedding as e3
from v a join v b on a.package = b.package and b.idx = a.idx % a.n + 1
         join v c on a.package = c.package and c.idx = (a.vec_id * 7919) % a.n + 1""",
    # reference vs candidate code; some candidates missing
    "results_long": """
select a.conv_id % 5 as dataset_name, case when a.conv_id % 2 = 0 then 'trained' else 'not_trained' end as variant,
  a.conv_id, a.turn, a.text as reference,
  case when (a.conv_id + a.turn) % 17 = 0 then cast(null as string) else b.text end as candidate
from {conversations} a join {conversations} b on a.conv_id = b.conv_id and b.turn = a.turn + 1
where a.role = 'user' and b.role = 'assistant'""",
    # model responses: fenced code, marker-delimited code, or plain text
    "generations": """
select conv_id, turn,
  case when turn % 3 = 0 then concat('Sure.', chr(10), '```python', chr(10), text, chr(10), '```', chr(10),
                                     'Also ```python', chr(10), 'pass', chr(10), '```')
       when turn % 3 = 1 then concat('#to_be_implemented', chr(10), text, chr(10), '#end_of_example', chr(10),
                                     '#to_be_implemented  ', cast(turn as string), chr(9), '#end_of_example tail')
       else text end as response
from {conversations}""",
    # run / step / metric / value, 100 steps to an epoch
    "metric_log": """
select run, step, cast(floor((step - 1) / 100.0) as bigint) as epoch, 'train_loss' as metric, value
from (select event_type as run, row_number() over (partition by event_type order by event_id) as step, value
      from {events}) t""",
    # source-file pairs for syntax / data-flow scores: a file and the next of its package
    "src_pairs": """
select a.package, a.doc_id, a.content as reference, b.content as candidate
from (select package, doc_id, content, row_number() over (partition by package order by doc_id) as idx,
             count(*) over (partition by package) as n from {src}) a
join (select package, doc_id, content, row_number() over (partition by package order by doc_id) as idx
      from {src}) b on a.package = b.package and b.idx = a.idx % a.n + 1""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def view_deps(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(VIEW_SQL[name])))


def _closure(names: list[str]) -> list[str]:
    """Fixture views needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in out:
            return
        for d in view_deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_with(views: list[str], body: str) -> str:
    """DuckDB text: ``WITH`` the needed fixture views, then ``body``."""
    parts = []
    for n in _closure(views):
        text = _PLACEHOLDER.sub(lambda m: m.group(1), VIEW_SQL[n]).strip()
        parts.append(f"{n} as (\n{text}\n)")
    body = body.strip()
    if not parts:
        return body
    if re.match(r"(?is)^with\s", body):
        # the body has its own WITH list: continue the fixture list with it
        return "with " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "with " + ",\n".join(parts) + "\n" + body


def _ranked(df: DataFrame, part: str, order: str, idx: str, n: str | None = None) -> DataFrame:
    """``row_number`` (and optionally the group size) without a per-group task."""
    from pyspark.sql import functions as F

    from codeloom.operators.ranking import running_rank

    out = running_rank(df, [part], order, width=1 << 16, out=idx)  # ids and keys of the tables are dense
    if n:
        sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias(n))
        out = out.join(sizes, part)
    return out


def _node_docs(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    d = t["documents"].select(
        F.col("source").alias("package"), "doc_id",
        F.concat("source", F.lit("/m.f"), F.col("doc_id").cast("string")).alias("node"),
        F.when(F.col("doc_id") % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("source_code"))
    return _ranked(d, "package", "doc_id", "idx", "n").select("package", "doc_id", "node", "source_code", "idx", "n")


def _metric_log(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    e = t["events"].select(F.col("event_type").alias("run"), "event_id", "value")
    r = _ranked(e, "run", "event_id", "step")
    return r.select("run", "step", F.floor((F.col("step") - 1) / F.lit(100.0)).cast("bigint").alias("epoch"),
                    F.lit("train_loss").alias("metric"), "value")


def _triplet_vectors(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    v = t["embeddings"].select("vec_id", (F.col("vec_id") % 10).alias("package"), "embedding")
    v = _ranked(v, "package", "vec_id", "idx", "n")
    a = v.select("package", F.col("vec_id").alias("anchor"), F.col("embedding").alias("e1"),
                 (F.col("idx") % F.col("n") + 1).alias("_pi"),
                 ((F.col("vec_id") * 7919) % F.col("n") + 1).alias("_ni"))
    b = v.select("package", F.col("idx").alias("_pi"), F.col("vec_id").alias("positive"), F.col("embedding").alias("e2"))
    c = v.select("package", F.col("idx").alias("_ni"), F.col("vec_id").alias("negative"), F.col("embedding").alias("e3"))
    out = a.join(b, ["package", "_pi"]).join(c, ["package", "_ni"])
    return out.select("package", "anchor", "positive", "negative", "e1", "e2", "e3")


def _src_pairs(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    s = _ranked(t["src"].select("package", "doc_id", "content"), "package", "doc_id", "idx", "n")
    a = s.select("package", "doc_id", F.col("content").alias("reference"), (F.col("idx") % F.col("n") + 1).alias("_j"))
    b = s.select("package", F.col("idx").alias("_j"), F.col("content").alias("candidate"))
    return a.join(b, ["package", "_j"]).select("package", "doc_id", "reference", "candidate")


def _counted_lines(t: "Tables") -> DataFrame:
    """One row per package that has a log: its number of lines."""
    from pyspark.sql import functions as F

    return t["call_lines"].where("package is not null").groupBy("package").agg(F.count(F.lit(1)).alias("n"))


def _call_log(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    announced = F.when(F.col("package") % 2 == 0, F.col("n")).otherwise(F.col("n") - 3)
    line = F.concat(F.lit("[INFO] ("), F.col("i").cast("string"), F.lit("/"), announced.cast("string"), F.lit(") "),
                    F.lit(chr(27)), F.lit("[0m"), F.col("entry"))
    lines = t["call_lines"].join(F.broadcast(_counted_lines(t)), "package")
    return lines.select("package", "line_no", line.alias("line"))


def _analyzer_log(t: "Tables") -> DataFrame:
    from pyspark.sql import functions as F

    head = ((-3, F.lit("[INFO] (1/5) preprocessing")), (-2, F.lit("Main interprocedural analysis phase...")),
            (-1, F.concat((F.col("package") * 10 + 50).cast("string"), F.lit(" functions will be analyzed."))))
    rows = F.array(*(F.struct(F.lit(no).cast("bigint").alias("line_no"), line.alias("line")) for no, line in head))
    return t["call_log"].unionByName(_counted_lines(t).select("package", F.inline(rows)))


# Spark builds these views with the bucketed ranking (same rows as the SQL,
# which the oracle keeps); their SQL windows would put a whole group in a task.
# The log's lines get their package's count by a broadcast, not dealt by package.
VIEW_BUILDERS = {
    "call_log": _call_log,
    "analyzer_log": _analyzer_log,
    "node_docs": _node_docs,
    "metric_log": _metric_log,
    "triplet_vectors": _triplet_vectors,
    "src_pairs": _src_pairs,
}


class Tables:
    """Lazy access to the given parquet tables and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = dict(overrides or {})
        #: Tasks for Python steps over the small test files, which arrive in one or two splits.
        self.partitions = spark.sparkContext.defaultParallelism

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                path = os.path.join(self.sf_dir, f"{name}.parquet")
                self._frames[name] = self.spark.read.parquet(path)
            elif name in VIEW_BUILDERS:
                self._frames[name] = VIEW_BUILDERS[name](self)
            elif name in VIEW_SQL:
                deps = {d: self.table(d) for d in view_deps(name)}
                self._frames[name] = self.spark.sql(VIEW_SQL[name], **deps)
            else:
                raise KeyError(f"unknown table or view: {name}")
        return self._frames[name]

    __getitem__ = table
