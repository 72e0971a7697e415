"""Queries: embeddings, generation, response parsing and file round trips.

Round-trip queries write a table Spark derives from the given tables into a
fresh folder under the session's ``spark.checkpoint.dir`` (a shared folder on
a cluster) and read it back with the matching reader.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.util import round6
from codeloom.operators import embed as E
from codeloom.operators import sampling as S
from codeloom.operators.projection import node_features, train_projection
from codeloom.operators.ranking import running_rank
from codeloom.plans.catalog.metrics_q import _SCORES_SQL, _cmp, _gm
from codeloom.plans.catalog.sampling_q import _SPLIT_SQL
from codeloom.plans.evaluation import evaluate_embedder, evaluate_on_nodes
from codeloom.plans.registry import query, sql_text
from codeloom.plans.retrieval import build_prompts
from codeloom.session import ensure_checkpoint_dir
from codeloom.sources import readers as R
from codeloom.sources import writers as W


def _scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/codeloom-{name}-{uuid.uuid4().hex[:12]}"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _last_pos_sql(x: str, m: str) -> str:
    return (f"(case when strpos({x}, '{m}') > 0 then length({x}) - strpos(reverse({x}), reverse('{m}')) "
            f"- length('{m}') + 2 end)")


@query("P14_extract_fenced_code", ["generations"],
       """select conv_id, turn, case when contains(response, '```python')
  then split_part(split_part(response, '```python', 2), '```', 1) else response end as code from generations""")
def p14(t):
    return t["generations"].select("conv_id", "turn", T.extract_fenced_code("response").alias("code"))


_PS, _PE = _last_pos_sql("response", T.START_MARKER), _last_pos_sql("response", T.END_MARKER)


@query("P15_extract_marked", ["generations"],
       f"""select conv_id, turn, case when ps is not null and pe is not null and ps < pe
  then {_strip_sql(f"substr(response, ps + {len(T.START_MARKER)}, pe - ps - {len(T.START_MARKER)})")}
  else response end as code
from (select conv_id, turn, response, {_PS} as ps, {_PE} as pe from generations) t""")
def p15(t):
    return t["generations"].select("conv_id", "turn", T.extract_marked("response").alias("code"))


@query("L5_generate", ["code_base"],
       f"""select dataset_name, id, {sql_text(chr(10) + 'def ')} || signature || {sql_text(':' + chr(10) + '    pass' + chr(10))}
  as generation from code_base""")
def l5(t):
    """Prompts → user model function on executors → fenced code (echo model)."""
    prompts = build_prompts(t["code_base"], with_context=False)
    return E.generate(prompts, E.echo_model, partitions=t.partitions).select("dataset_name", "id", "generation")


@query("M4_embed", ["code_base"],
       """select dataset_name, id, 4096 as dim,
  cast(case when trim(regexp_replace(raw_source_code, '\\s', ' ', 'g')) = '' then 0.0 else 1.0 end as double) as norm
from code_base""")
def m4(t):
    """Default (untrained) embedder over every function's code: unit vectors."""
    e = E.embed(t["code_base"].select("dataset_name", "id", "raw_source_code"), "raw_source_code")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("dataset_name", "id", F.size("embedding").alias("dim"), round6(norm).alias("norm"))


def _times(a: str, c: int) -> str:
    return f"((({a})::hugeint * {c}) % 4294967296)::bigint"


def _rotated(x: str, n: int) -> str:
    return f"(((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295)"


def _feature_sql() -> str:
    """Feature of a token: its 32-bit MurmurHash3 with seed 42, as published, modulo 4096."""
    mixed = lambda k: _times(_rotated(_times(k, 3432918353), 15), 461845907)
    block = "(b[4 * i + 1] | (b[4 * i + 2] << 8) | (b[4 * i + 3] << 16) | (b[4 * i + 4] << 24))"
    return f"""
byte as (select token, n, list_transform(range(1, n + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint) as b
         from (select token, octet_length(encode(token)) as n, hex(encode(token)) as x from (select distinct token from tok) d) h),
body as (select token, n, b, list_reduce(list_prepend(42::bigint, list_transform(range(n // 4), lambda i: {mixed(block)})),
                lambda h, k: ({_rotated('xor(h, k)', 13)} * 5 + 3864292196) & 4294967295) as h from byte),
last as (select token, n, list_reduce(list_prepend(0::bigint, list_transform(range(n % 4), lambda i: (b[4 * (n // 4) + i + 1] << (8 * i)))),
                lambda a, c: a | c) as k, h from body),
done as (select token, xor(xor(h, {mixed('k')}), n) as h from last),
f1 as (select token, {_times('xor(h, h >> 16)', 2246822507)} as h from done),
f2 as (select token, {_times('xor(h, h >> 13)', 3266489909)} as h from f1),
hashed as (select token, xor(h, h >> 16) % 4096 as feature from f2)"""


_VECTOR_SQL = f"""with tok as (
  select dataset_name, id, unnest(regexp_extract_all(raw_source_code, '[^ \\t\\n\\x0B\\f\\r]+')) as token from code_base),{_feature_sql()},
tf as (select dataset_name, id, feature, count(*) as c from tok join hashed using (token) group by dataset_name, id, feature)
select dataset_name, id, cast(feature as integer) as feature,
  round(c / sqrt(sum(c * c) over (partition by dataset_name, id)), 6) as weight from tf"""


@query("M4_embed_vectors", ["code_base"], _VECTOR_SQL)
def m4_vectors(t):
    """The default embedder's vectors themselves: every feature that a function's code has, with its weight."""
    e = E.embed(t["code_base"].select("dataset_name", "id", "raw_source_code"), "raw_source_code", dense=False)
    sparse = F.unwrap_udt("embedding")
    parts = F.arrays_zip(sparse["indices"].alias("feature"), sparse["values"].alias("weight"))
    return e.select("dataset_name", "id", F.inline(parts)).select("dataset_name", "id", "feature", round6("weight").alias("weight"))


@query("M5_train_embedder", ["node_docs", "edge_docs"], None)
def m5(t):
    """Word2Vec fitted on the train split's code; triplet metrics on validation."""
    nodes, edges = t["node_docs"], t["edge_docs"]
    split = S.group_split(S.package_sizes(nodes, edges), val=0.2, seed=42)
    train_pk = split.filter(F.col("split") == "train").select("package")
    texts = nodes.join(train_pk, "package").select(F.col("source_code").alias("text"))
    model = E.train_embedder(texts, dim=32)
    held = split.filter(F.col("split") == "validation").select("package")
    return evaluate_on_nodes(edges.join(held, "package"), nodes.join(held, "package"), model, "edge_id", "doc_id")


@query("M5_train_projection", ["node_docs", "edge_docs"], f"""with {_SPLIT_SQL.strip()}
select count(*) as triplets, true as loss_falls from edge_docs e join split s on s.package = e.package where s.split = 'validation'""")
def m5_hinge(t):
    """A projection trained on the train split's triplet hinge: its loss on validation falls below the untrained embedder's."""
    nodes, edges = t["node_docs"], t["edge_docs"]
    split = S.group_split(S.package_sizes(nodes, edges), val=0.2, seed=42)
    side = {x: split.filter(F.col("split") == x).select("package") for x in ("train", "validation")}
    part = lambda x: (edges.join(side[x], "package"), nodes.join(side[x], "package"))
    model, _ = train_projection(node_features(*part("train"), "edge_id", "doc_id"), "edge_id")
    before = evaluate_embedder(S.triplets(*part("validation"), "edge_id", "doc_id"), None)
    after = evaluate_on_nodes(*part("validation"), model, "edge_id", "doc_id")
    before, after = (x.select("triplets", F.col("val_loss").alias(c)) for x, c in ((before, "a"), (after, "b")))
    return after.join(before, "triplets").select("triplets", (F.col("b") < F.col("a")).alias("loss_falls"))


@query("S1_read_package_list", ["part"],
       "select trim(p_name) as name from part where trim(p_name) <> ''")
def s1(t):
    """Package-list rule (trim, drop blanks) over a name column of the tables."""
    return R.package_list(t["part"], col="p_name")


def _graph_nodes(t):
    empty = F.lit(None).cast("string")
    return t["node_docs"].select("package", "node", "source_code", empty.alias("description"), empty.alias("signature"))


@query("K1_K2_graph_roundtrip", ["node_docs", "edge_docs"],
       """select package, 'edge' as kind, node1 as a, node2 as b, type from edge_docs
union all select package, 'node', node, source_code, null from node_docs""")
def k12(t):
    """Nodes and edges written partitioned by package (parquet) and read back."""
    root = _scratch(t.spark, "graph")
    W.write_graph(_graph_nodes(t), t["edge_docs"], root, files_per_package=4)
    nodes, edges = R.read_graph(t.spark, root, layout="parquet")
    return edges.select("package", F.lit("edge").alias("kind"), F.col("node1").alias("a"), F.col("node2").alias("b"), "type") \
        .union(nodes.select("package", F.lit("node"), "node", "source_code", F.lit(None).cast("int")))


@query("S6_read_graph_nodes", ["node_docs", "edge_docs"],
       """select package, 'node' as kind, node as a, source_code as b from node_docs
union all select package, 'edge', node1, node2 from edge_docs""")
def s6(t):
    """CSV graphs with multi-line, quoted source code and two column orders."""
    root = _scratch(t.spark, "graph csv")
    early = F.col("package") < "src5"
    nodes = _graph_nodes(t)
    for part, order in ((nodes.filter(early), ("node", "signature", "description", "source_code")),
                        (nodes.filter(~early), ("source_code", "node"))):
        W._csv_writer(part.select(*order, "package"), "append").partitionBy("package").csv(f"{root}/nodes")
    W._csv_writer(t["edge_docs"].select("type", "node2", "node1", "package"), "append").partitionBy("package").csv(f"{root}/edges")
    nodes, edges = R.read_graph(t.spark, root, layout="partitioned")
    return nodes.select("package", F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("source_code").alias("b")) \
        .union(edges.select("package", F.lit("edge"), "node1", "node2"))


@query("K3_results_roundtrip", ["results_long"],
       """select cast(dataset_name as varchar) as dataset_name, conv_id || ':' || turn as signature, variant, reference, candidate
from results_long""")
def k3(t):
    """Long results written as one file layout per variant, read back by header."""
    root = _scratch(t.spark, "results")
    rows = t["results_long"].withColumn("signature", F.concat_ws(":", "conv_id", "turn"))
    W.write_results(rows, root)
    back = R.read_results(t.spark, root, "*/*/*.csv", variants=("trained", "not_trained"))
    return back.select("dataset_name", "signature", "variant", "reference", "candidate")


@query("S7_read_function_base", ["code_base"],
       "select dataset_name, signature, comment, raw_source_code, '[0.5, 0.25]' as embeddings from code_base")
def s7(t):
    """Function bases with two column orders (original column names), read back."""
    root = _scratch(t.spark, "function base")
    base = t["code_base"].withColumn("embeddings", F.lit("[0.5, 0.25]")).withColumnRenamed("signature", "function signature")
    early = F.col("dataset_name") < "src5"
    for part, order in ((base.filter(early), ("function signature", "comment", "raw_source_code", "embeddings")),
                        (base.filter(~early), ("embeddings", "raw_source_code", "function signature", "comment"))):
        W._csv_writer(part.select(*order, "dataset_name"), "append").partitionBy("dataset_name").csv(root)
    return R.read_function_base(t.spark, root, name="*.csv")


@query("S8_read_results", ["results_long"],
       """select cast(dataset_name as varchar) as dataset_name, 'f' || cast(conv_id as string) as signature, reference,
  'context_generation' as variant, candidate from results_long where variant = 'trained'
union all select cast(dataset_name as varchar), null, reference, unnest(['simple_generation', 'context_generation']), candidate
from results_long where variant <> 'trained'""")
def s8(t):
    """Result CSVs of the current layout, with an index column and another column
    order, and of the older one with two variants, read back in long form."""
    root = _scratch(t.spark, "res")
    rl = t["results_long"]
    current = rl.filter(F.col("variant") == "trained").select(
        F.col("turn").alias("index"), F.col("reference").alias("source code"),
        F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("function signature"),
        F.col("candidate").alias("context_generation"), "dataset_name")
    older = rl.filter(F.col("variant") != "trained").select(
        F.col("reference").alias("ground_truth"), F.col("candidate").alias("simple_generation"),
        F.col("candidate").alias("context_generation"), "dataset_name")
    for name, df in (("current", current), ("older", older)):
        W._csv_writer(df, "overwrite").partitionBy("dataset_name").csv(f"{root}/{name}")
    return R.read_results(t.spark, root, pattern="*/*/*.csv").drop("file")


@query("K4_S9_metrics_roundtrip", ["results_long"],
       _SCORES_SQL + """
select cast(dataset_name as varchar) as dataset_name, variant as file, unnest([
    {'metric': metric, 'value': round(mean, 6)}, {'metric': metric || '_std', 'value': round(std, 6)}], recursive := true)
from gm""")
def k4s9(t):
    """Mean and std of each dataset's files as JSON objects, read back in full."""
    root = _scratch(t.spark, "metrics")
    W.write_metrics(_gm(t).withColumnRenamed("variant", "file"), root)
    back = R.read_metrics(t.spark, root, layout="partitioned")
    return back.select("dataset_name", "file", "metric", round6("value").alias("value"))


def _files(df, root: str, key: str, order: list[str], value: str, **options):
    """One text file for each ``key``, its lines in ``order``: input for the file readers."""
    one = df.repartition(key).sortWithinPartitions(key, *order).select(key, F.col(value).alias("value"))
    writer = one.write.partitionBy(key)
    for name, x in options.items():
        writer = writer.option(name, x)
    writer.text(root)


@query("S5_read_analyzer_log", ["analyzer_log"],
       """select cast(package as varchar) as package, line, row_number() over (partition by package order by line_no) as place
from analyzer_log""")
def s5(t):
    """Analyzer logs written as text files, read back in line order."""
    root = _scratch(t.spark, "logs")
    _files(t["analyzer_log"], root, "package", ["line_no"], "line")
    back = R.read_analyzer_log(t.spark, f"{root}/*/*", name_from="folder")
    return running_rank(back, ["package"], "line_no", out="place").select("package", "line", "place")


_CALLS_SQL = """
select cast(e.package as varchar) as package, e.function as caller,
       row_number() over (partition by e.package, e.function order by c.callee) - 1 as pos, c.callee
from graph_entries e join raw_calls c on c.package = e.package and c.caller = e.function"""


def _call_graph(t):
    """Call-graph JSON files of every package, with a field that the reader leaves out."""
    root = _scratch(t.spark, "call graphs")
    calls = t["raw_calls"].groupBy("package", F.col("caller").alias("function")).agg(F.array_sort(F.collect_list("callee")).alias("callees"))
    entry = F.to_json(F.struct(F.col("function").alias("id"), "function", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"),
                               F.lit("not read").alias("source")))
    rows = t["graph_entries"].join(calls, ["package", "function"], "left").select("package", "function", entry.alias("e"))
    whole = rows.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("e")), ",\n").alias("e"))
    whole = whole.withColumn("value", F.concat(F.lit('{"call-graph-v1.0": [\n'), "e", F.lit("\n]}")))
    _files(whole, root, "package", ["value"], "value")
    return R.read_call_graph(t.spark, f"{root}/*/*", name_from="folder")


@query("S4_read_call_graph", ["graph_entries", "raw_calls"], _CALLS_SQL)
def s4(t):
    """Calls of the call-graph JSON files, each with its place in the callee list."""
    return _call_graph(t)[1].withColumn("pos", F.col("pos").cast("long"))


@query("P21_prune_fields", ["graph_entries"], "select cast(package as varchar) as package, function as id, function from graph_entries")
def p21(t):
    """Entries of the call-graph JSON files without their ``source`` field."""
    return _call_graph(t)[0]


def _folder(c: str):
    """``key=value`` as Spark's writers name it."""
    value = F.coalesce(F.replace(F.col(c), F.lit("/"), F.lit("%2F")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return F.concat(F.lit(f"{c}="), value)


@query("S3_read_source_files", ["src"],
       "select 'pkg ' || package as package, regexp_extract(path, '[^/]*$') as name, content from src")
def s3(t):
    """Source files in folders with a blank, read back by their real paths."""
    root = _scratch(t.spark, "source tree")
    src = t["src"].select(F.concat(F.lit("pkg "), "package").alias("p"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    value = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"))
    W.write_files(src.select(F.concat(_folder("p"), F.lit("/"), _folder("name")).alias("path"), value.alias("content")), root)
    back = R.read_source_files(t.spark, root, pattern="name=*")
    return back.select(F.regexp_extract("path", "^p=([^/]*)/", 1).alias("package"), F.regexp_extract("path", "/name=([^/]*)$", 1).alias("name"),
                       F.expr("left(content, length(content) - 1)").alias("content"))


def _tarball(key, files):
    import io
    import tarfile

    import pyarrow as pa

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for path, content in zip(files.column("path").to_pylist(), files.column("content").to_pylist()):
            info = tarfile.TarInfo(path)
            info.size = len(content.encode())
            tar.addfile(info, io.BytesIO(content.encode()))
    return pa.table({"package": pa.array([key[0].as_py()]), "value": pa.array([out.getvalue()], pa.binary())})


@query("S2_read_archives", ["src"], "select package as archive, path, content, cast(null as varchar) as error from src")
def s2(t):
    """Archives of every package's files (gzipped tar), read back member by member."""
    root = _scratch(t.spark, "archives")
    tars = t["src"].select("package", "path", "content").groupBy("package").applyInArrow(_tarball, "package string, value binary")
    tars = tars.select("package", F.col("value").cast("string").alias("value"))
    _files(tars, root, "package", ["package"], "value", compression="gzip")
    return R.read_archives(t.spark, f"{root}/*/*.gz", name_from="folder")


@query("P11_context_block", ["generations"],
       f"""select conv_id, {sql_text(T.CONTEXT_HEADING)} || string_agg(response || {sql_text(T.CONTEXT_SEPARATOR)}, '' order by turn) as context
from generations group by conv_id""")
def p11(t):
    """A conversation's texts as one context block, in order."""
    g = t["generations"].groupBy("conv_id").agg(T.ordered_sources("turn", "response").alias("sources"))
    return g.select("conv_id", T.context_block("sources").alias("context"))


@query("P12_build_prompt", ["generations"],
       f"""select conv_id, turn, {sql_text(T.PROMPT_HEAD)} || response || {sql_text(T.PROMPT_SIGNATURE_HEADING)} || 'f(%s, {{}}) ' || conv_id
  || {sql_text(T.PROMPT_TAIL)} as prompt from generations""")
def p12(t):
    """A prompt from a signature (with format characters in it) and a context."""
    sig = F.concat(F.lit("f(%s, {}) "), F.col("conv_id").cast("string"))
    return t["generations"].select("conv_id", "turn", T.build_prompt(sig, F.col("response")).alias("prompt"))


@query("K7_save_load_embedder", ["code_base"],
       """select dataset_name, id, 256 as dim,
  cast(case when trim(regexp_replace(raw_source_code, '\\s', ' ', 'g')) = '' then 0.0 else 1.0 end as double) as norm, true as same
from code_base""")
def k7(t):
    """An embedder saved, loaded, and giving the same vectors."""
    path = _scratch(t.spark, "embedder")
    texts = t["code_base"].select("dataset_name", "id", "raw_source_code")
    model = E.hashing_embedder(256).fit(texts.limit(0).withColumn("_text", F.lit("")))
    W.save_embedder(model, path)
    both = E.embed(E.embed(texts, "raw_source_code", model, out="first"), "raw_source_code", W.load_embedder(path), out="again")
    norm = F.sqrt(F.aggregate("again", F.lit(0.0), lambda a, x: a + x * x))
    return both.select("dataset_name", "id", F.size("again").alias("dim"), round6(norm).alias("norm"), (F.col("first") == F.col("again")).alias("same"))


@query("K5_write_comparison", ["results_long"],
       _SCORES_SQL + "\nselect metric, round(trained, 6) as trained, round(not_trained, 6) as not_trained from cmp")
def k5(t):
    """The variant comparison written as one CSV and read back."""
    root = _scratch(t.spark, "cmp")
    W.write_comparison(_cmp(t), root)
    back = t.spark.read.option("header", True).schema("metric string, trained double, not_trained double").csv(root)
    return back.select("metric", round6("trained").alias("trained"), round6("not_trained").alias("not_trained"))


@query("K6_append_metric_log", ["metric_log"], "select run, step, metric, value from metric_log")
def k6(t):
    """Training-log rows appended to a table partitioned by run, read back."""
    root = _scratch(t.spark, "mlog")
    W.append_metric_log(t["metric_log"], root, backend="table")
    return t.spark.read.parquet(root).select("run", "step", "metric", "value")


@query("W6_head", ["edge_docs"],
       "select package, edge_id, node1, node2 from edge_docs order by package, edge_id limit 5")
def w6(t):
    """First rows for inspection (the limit is the feature)."""
    return t["edge_docs"].orderBy("package", "edge_id").limit(5).select("package", "edge_id", "node1", "node2")


@query("W6_nth_row", ["results_long"],
       """select dataset_name, conv_id, turn, reference from (
  select *, row_number() over (partition by dataset_name order by conv_id, turn) as rn from results_long) t
where rn = 2""")
def w6n(t):
    """Row ``i = 1`` (0-based) of every dataset."""
    r = running_rank(t["results_long"], ["dataset_name"], "conv_id", tiebreak=["turn"], out="_rn")
    return r.filter(F.col("_rn") == 2).select("dataset_name", "conv_id", "turn", "reference")
