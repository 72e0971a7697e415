"""Readers and writers: small files of each input shape, written to a fresh
temporary folder and read back."""

import io
import json
import os
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.operators import embed as E
from codeloom.operators import graph as G
from codeloom.sources import readers as R
from codeloom.sources import writers as W

CODE = 'def f(a):\n    """say "hi", twice"""\n    return g(a)\n'


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as fh:
        fh.write(text)


def test_read_graph_folders(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/p1")
    pd.DataFrame({"node": ["m.f", "m.g"], "source_code": [CODE, "NA"], "description": [None, "d"],
                  "signature": ["f(a)", "g()"]}).to_csv(f"{tmp_dir}/p1/nodes.csv", index=False)
    pd.DataFrame({"node1": ["m.f"], "node2": ["m.g"], "type": [0]}).to_csv(f"{tmp_dir}/p1/edges.csv", index=False)
    # legacy folder: two-column files, unknown targets
    os.makedirs(f"{tmp_dir}/p2")
    pd.DataFrame({"node": ["a.h"], "source_code": ["def h():\n    pass"]}).to_csv(f"{tmp_dir}/p2/nodes.csv", index=False)
    pd.DataFrame({"node1": ["a.h", "a.h"], "node2": ["<unk>.print", "<unk>.print"]}).to_csv(
        f"{tmp_dir}/p2/edges.csv", index=False)
    # a folder without edges is skipped
    os.makedirs(f"{tmp_dir}/p3")
    pd.DataFrame({"node": ["x"], "source_code": ["y"]}).to_csv(f"{tmp_dir}/p3/nodes.csv", index=False)
    nodes, edges = R.read_graph(spark, tmp_dir)
    n = {r["node"]: r for r in nodes.collect()}
    assert set(n) == {"m.f", "m.g", "a.h"}
    assert n["m.f"]["source_code"] == CODE
    assert n["m.g"]["source_code"] is None  # pandas reads NA as missing
    e = sorted((r["package"], r["node2"], r["type"]) for r in edges.collect())
    assert e == [("p1", "m.g", 0), ("p2", "<unk>.print", None), ("p2", "<unk>.print", None)]


def test_write_read_graph_partitioned(spark, tmp_dir):
    nodes = spark.createDataFrame([("p", "m.f", CODE, None, "f(a)")],
                                  "package string, node string, source_code string, description string, signature string")
    edges = spark.createDataFrame([("p", "m.f", "m.f")], "package string, node1 string, node2 string")
    for fmt, layout in (("parquet", "parquet"), ("csv", "partitioned")):
        W.write_graph(nodes, edges, f"{tmp_dir}/{fmt}", fmt)
        n, e = R.read_graph(spark, f"{tmp_dir}/{fmt}", layout=layout)
        assert n.first()["source_code"] == CODE
        assert e.first()["type"] == 0


def test_call_graph_and_log(spark, tmp_dir):
    graph = {"call-graph-v1.0": [
        {"id": "1", "function": "a.py:<module>:f", "callees": ["a.py:<module>:g::1", "builtin.py:<module>:len"],
         "source": "ignored"},
        {"id": "2", "function": "a.py:<module>:g", "callees": []},
    ]}
    _write(f"{tmp_dir}/cg/pk-graph-order.json", json.dumps(graph, indent=2))
    entries, calls = R.read_call_graph(spark, f"{tmp_dir}/cg/*.json")
    assert sorted(r["function"] for r in entries.collect()) == ["a.py:<module>:f", "a.py:<module>:g"]
    assert entries.first()["package"] == "pk"
    assert [r["callee"] for r in calls.orderBy("pos").collect()] == ["a.py:<module>:g::1", "builtin.py:<module>:len"]
    log = "\n".join([
        "start", "Main interprocedural analysis phase...", "2 functions will be analyzed.",
        "[I] (1/2) \x1b[0mf (from /w/pk/src/a.py)", "[I] (2/2) \x1b[0mg (from /w/pk/src/a.py)", "done (5/5)",
    ])
    _write(f"{tmp_dir}/logs/pk.log", log)
    lines = R.read_analyzer_log(spark, f"{tmp_dir}/logs/*.log")
    assert lines.count() == 6
    kept = G.after_marker(lines)
    roots = spark.createDataFrame([("pk", "/w/pk")], "package string, root string")
    resolved, _ = G.attach_paths(entries, G.name_to_path(G.log_entries(kept, roots)))
    edges = G.resolve_edges(calls, resolved).collect()
    assert [(r["node1"], r["node2"]) for r in edges] == [("src/a.f", "src/a.g")]


def test_source_files_crlf(spark, tmp_dir):
    _write(f"{tmp_dir}/src/pkg/mod/a.py", "def f():\r\n    return 1\r\n", "w")
    _write(f"{tmp_dir}/src/pkg/readme.txt", "not code")
    df = R.read_source_files(spark, f"{tmp_dir}/src").collect()
    assert len(df) == 1
    assert df[0]["package"] == "pkg" and df[0]["path"] == "pkg/mod/a.py"
    assert df[0]["content"] == "def f():\n    return 1\n"


def test_archives(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/arc")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, text in [("lib-1.0/lib/a.py", "x = 1\n"), ("lib-1.0/README", "r")]:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    with open(f"{tmp_dir}/arc/lib-1.0.tar.gz", "wb") as fh:
        fh.write(buf.getvalue())
    with open(f"{tmp_dir}/arc/bad-2.0.tar.gz", "wb") as fh:
        fh.write(b"not an archive")
    rows = {(r["archive"], r["path"]): r for r in R.read_archives(spark, f"{tmp_dir}/arc/*.tar.gz").collect()}
    assert rows[("lib-1.0", "lib-1.0/lib/a.py")]["content"] == "x = 1\n"
    bad = [r for r in rows.values() if r["archive"] == "bad-2.0"]
    assert len(bad) == 1 and bad[0]["error"]
    assert os.path.exists(f"{tmp_dir}/arc/lib-1.0.tar.gz")  # input is never deleted


def test_function_base_and_required_column(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/fb/ds1")
    pd.DataFrame({"function signature": ["f(a)"], "comment": ["c"], "raw_source_code": [CODE],
                  "embeddings": ["[0.1, 0.2]"]}).to_csv(f"{tmp_dir}/fb/ds1/function_base.csv", index=False)
    df = R.read_function_base(spark, f"{tmp_dir}/fb").first()
    assert df["dataset_name"] == "ds1" and df["signature"] == "f(a)" and df["raw_source_code"] == CODE
    os.makedirs(f"{tmp_dir}/fb2/ds")
    pd.DataFrame({"function signature": ["f"], "code": ["x"]}).to_csv(f"{tmp_dir}/fb2/ds/function_base.csv", index=False)
    with pytest.raises(ValueError):
        R.read_function_base(spark, f"{tmp_dir}/fb2")


def test_results_both_layouts_and_metrics(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/res/ds1")
    pd.DataFrame({"function signature": ["f(a)"], "source code": [CODE], "context_generation": ["def f(a): pass"]}) \
        .to_csv(f"{tmp_dir}/res/ds1/results.csv", index=False)
    pd.DataFrame({"ground_truth": ["x = 1"], "simple_generation": ["x = 2"], "context_generation": ["x = 1"]}) \
        .to_csv(f"{tmp_dir}/res/ds1/final_result.csv", index=False)
    rows = sorted((r["file"], r["variant"], r["reference"], r["candidate"]) for r in R.read_results(spark, f"{tmp_dir}/res").collect())
    assert rows == [("final_result", "context_generation", "x = 1", "x = 1"),
                    ("final_result", "simple_generation", "x = 1", "x = 2"),
                    ("results", "context_generation", CODE, "def f(a): pass")]
    _write(f"{tmp_dir}/m/ds1/metrics/results.json", json.dumps({"codebleu": 0.5, "codebleu_std": 0.1}))
    _write(f"{tmp_dir}/m/ds2/metrics/results.json", json.dumps({"codebleu": 0.7, "levenshtein_distance": 3.0}))
    _write(f"{tmp_dir}/m/ds2/metrics/other file.json", json.dumps({"codebleu": None}, indent=2))
    got = {(r["dataset_name"], r["file"], r["metric"]): r["value"] for r in R.read_metrics(spark, f"{tmp_dir}/m").collect()}
    assert got == {("ds1", "results", "codebleu"): 0.5, ("ds1", "results", "codebleu_std"): 0.1, ("ds2", "results", "codebleu"): 0.7,
                   ("ds2", "results", "levenshtein_distance"): 3.0, ("ds2", "other file", "codebleu"): None}
    _write(f"{tmp_dir}/m/ds3/metrics/results.json", "[1, 2]")
    with pytest.raises(Exception, match="not an object of metrics"):
        R.read_metrics(spark, f"{tmp_dir}/m").collect()


def test_files_are_read_by_their_own_headers(spark, tmp_dir):
    """Column order, further columns and an index differ between files and folders with blanks."""
    os.makedirs(f"{tmp_dir}/my graphs/p 1")
    os.makedirs(f"{tmp_dir}/my graphs/p[2]")
    pd.DataFrame({"node": ["node"], "signature": ["f()"], "description": ["d"], "source_code": [CODE]}).to_csv(
        f"{tmp_dir}/my graphs/p 1/nodes.csv", index=False)
    pd.DataFrame({"type": [0], "node1": ["a"], "node2": ["b"]}).to_csv(f"{tmp_dir}/my graphs/p 1/edges.csv", index=False)
    pd.DataFrame({"source_code": ["x"], "node": ["n"]}).to_csv(f"{tmp_dir}/my graphs/p[2]/nodes.csv")
    pd.DataFrame({"node2": ["d"], "node1": ["c"]}).to_csv(f"{tmp_dir}/my graphs/p[2]/edges.csv")
    nodes, edges = R.read_graph(spark, f"{tmp_dir}/my graphs")
    assert sorted(tuple(r) for r in nodes.select("package", "node", "source_code").collect()) == [("p 1", "node", CODE), ("p[2]", "n", "x")]
    assert sorted(tuple(r) for r in edges.collect()) == [("p 1", "a", "b", 0), ("p[2]", "c", "d", None)]
    for name, frame in (("a", {"signature": ["s"], "source code": ["signature"], "no_context_generation": ["c"]}),
                        ("b", {"context_generation": ["c2"], "function signature": ["function signature"], "source code": ["r2"]})):
        os.makedirs(f"{tmp_dir}/res/{name}")
        pd.DataFrame(frame).to_csv(f"{tmp_dir}/res/{name}/out.csv")
    got = sorted((r["dataset_name"], r["signature"], r["reference"], r["variant"], r["candidate"]) for r in R.read_results(spark, f"{tmp_dir}/res").collect())
    assert got == [("a", None, "signature", "no_context_generation", "c"), ("b", "function signature", "r2", "context_generation", "c2")]
    os.makedirs(f"{tmp_dir}/res/c")
    pd.DataFrame({"question": ["q"], "answer": ["a"]}).to_csv(f"{tmp_dir}/res/c/out.csv")
    with pytest.raises(ValueError, match="no reference or variant"):
        R.read_results(spark, f"{tmp_dir}/res")


def test_source_paths_with_blanks_and_a_foreign_root(spark, tmp_dir):
    _write(f"{tmp_dir}/my src/pkg one/a b+c%20.py", "x = 1\n")
    row = R.read_source_files(spark, f"{tmp_dir}/my src").first()
    assert (row["package"], row["path"], row["content"]) == ("pkg one", "pkg one/a b+c%20.py", "x = 1\n")
    row = R.read_source_files(spark, f"file://{tmp_dir}/my src").first()
    assert row["package"] == "pkg one"
    with pytest.raises(Exception, match="not below"):
        R.read_source_files(spark, f"{tmp_dir}/my src/pkg*").collect()


def test_a_bad_archive_leaves_no_member(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/arc")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for k in range(200):
            data = os.urandom(3000) if k else "é = 1\n".encode("latin-1")
            info = tarfile.TarInfo(f"m{k}.py")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    for name, data in (("whole", buf.getvalue()), ("cut", buf.getvalue()[: len(buf.getvalue()) // 2])):
        with open(f"{tmp_dir}/arc/{name}.tar.gz", "wb") as fh:
            fh.write(data)
    rows = R.read_archives(spark, f"{tmp_dir}/arc/*.tar.gz").collect()
    cut = [r for r in rows if r["archive"] == "cut"]
    assert len(cut) == 1 and cut[0]["path"] is None and cut[0]["error"]
    assert sum(r["archive"] == "whole" for r in rows) == 200
    assert all("replacements" in r["error"] for r in rows if r["path"] == "m0.py")


def test_analyzer_log_keeps_line_order_over_splits(spark, tmp_dir):
    for name in ("a b", "c"):
        _write(f"{tmp_dir}/logs/{name}.log", "".join(f"line {k}\n" if k % 3 else "\n" for k in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = R.read_analyzer_log(spark, f"{tmp_dir}/logs/*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a b", "c"):
        own = sorted((r["line_no"], r["line"]) for r in rows if r["package"] == name)
        assert len({n for n, _ in own}) == 4000
        assert [x for _, x in own] == [f"line {k}" if k % 3 else "" for k in range(4000)]


def test_metric_log_backends(spark, tmp_dir):
    log = spark.createDataFrame([("r1", 1, "train_loss", 0.5)], "run string, step long, metric string, value double")
    W.append_metric_log(log, f"{tmp_dir}/ml", backend="table")
    W.append_metric_log(log, f"{tmp_dir}/ml", backend="table")
    assert spark.read.parquet(f"{tmp_dir}/ml").count() == 1  # a repeated call adds nothing
    W.append_metric_log(log.withColumn("step", F.lit(2)), f"{tmp_dir}/ml", backend="table")
    assert spark.read.parquet(f"{tmp_dir}/ml").count() == 2
    W.append_metric_log(log, backend=None)
    with pytest.raises(ValueError):
        W.append_metric_log(log, backend="remote")


def test_metric_log_compares_with_overlapping_appends_only(spark, tmp_dir):
    rows = lambda run, first, last: spark.range(first, last + 1).select(
        F.lit(run).alias("run"), F.col("id").alias("step"), F.lit("loss").alias("metric"), (F.col("id") * 0.5).alias("value"))
    path = f"{tmp_dir}/ml"
    for part in (rows("a", 1, 100), rows("a", 101, 200), rows("b", 101, 200), rows("a", 301, 400).union(rows("b", 1, 50))):
        W.append_metric_log(part, path)
    new = rows("a", 150, 210)
    known = W.recorded_steps(spark, path, new)
    scan = next(x for x in known._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    parts, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "batch" in parts and "run" in parts and "GreaterThanOrEqual(step,150)" in pushed
    files = {r[0] for r in known.select(F.input_file_name()).collect()}
    assert files and all("/run=a/" in f for f in files) and len({f.split("/batch=")[1][:32] for f in files}) == 1
    assert W.recorded_steps(spark, path, rows("a", 201, 300)) is None and W.recorded_steps(spark, path, rows("c", 1, 9)) is None
    W.append_metric_log(new, path)
    W.append_metric_log(new.union(rows("b", 40, 60)), path)
    got = sorted((r["run"], r["step"], r["value"]) for r in spark.read.parquet(path).collect())
    steps = [("a", k) for k in (*range(1, 211), *range(301, 401))] + [("b", k) for k in (*range(1, 61), *range(101, 201))]
    assert got == [(run, k, k * 0.5) for run, k in steps]


def test_embedder_save_load_same_vectors(spark, tmp_dir):
    df = spark.createDataFrame([(1, "def f(a): return a"), (2, "x = y + z")], "id long, text string")
    model = E.train_embedder(df, dim=8, min_count=1)
    a = {r["id"]: r["embedding"] for r in E.embed(df, "text", model).collect()}
    W.save_embedder(model, f"{tmp_dir}/model")
    b = {r["id"]: r["embedding"] for r in E.embed(df, "text", W.load_embedder(f"{tmp_dir}/model")).collect()}
    assert a == b and len(a[1]) == 8


def test_generate_with_user_function(spark):
    df = spark.createDataFrame([(1, "...\nFunction signature:\nf(a)\n")], "id long, prompt string")
    out = E.generate(df, E.echo_model).first()
    assert out["generation"] == "\ndef f(a):\n    pass\n"


def test_package_list_and_salted_write(spark, tmp_dir):
    _write(f"{tmp_dir}/list.txt", "alpha\n\n  beta \nalpha\n   \n")
    assert [r["name"] for r in R.read_package_list(spark, f"{tmp_dir}/list.txt").collect()] == ["alpha", "beta", "alpha"]
    assert sorted(r["name"] for r in R.read_package_list(spark, f"{tmp_dir}/list.txt", distinct=True).collect()) \
        == ["alpha", "beta"]
    edges = spark.createDataFrame([("hot", f"a{i}", f"b{i}", 0) for i in range(200)] + [("cold", "x", "y", 0)],
                                  "package string, node1 string, node2 string, type int")
    W.write_edges(edges, f"{tmp_dir}/e", "csv", files_per_package=4)
    hot = [f for f in os.listdir(f"{tmp_dir}/e/package=hot") if f.endswith(".csv")]
    assert 1 < len(hot) <= 4
    back = spark.read.option("header", True).csv(f"{tmp_dir}/e")
    assert back.count() == 201


def test_generate_marked_and_raw(spark):
    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    fn = lambda s: s.map(lambda _: "x #to_be_implemented\n  body()  \n#end_of_example tail")
    assert E.generate(df, fn, extract="marked").first()["generation"] == "body()"
    assert E.generate(df, fn, extract=None).first()["generation"].startswith("x #to_be")


def test_files_are_written_by_the_tasks_without_a_folder_each(spark, tmp_dir):
    rows = [(f"p=pkg {k % 3}/name=m{k}.py", f"x = {k}\n# é\n") for k in range(40)]
    rows += [("p=pkg 0/name=twice.py", "a\n"), ("p=pkg 0/name=twice.py", "a\n"), ("p=pkg 1/name=empty.py", None)]
    assert W.write_files(spark.createDataFrame(rows, "path string, content string").repartition(5), f"file:{tmp_dir}/tree") == 42
    folders = [d for d, _, files in os.walk(f"{tmp_dir}/tree") if files]
    assert sorted(os.path.basename(d) for d in folders) == ["p=pkg 0", "p=pkg 1", "p=pkg 2"]
    back = {r["path"]: r["content"] for r in R.read_source_files(spark, f"{tmp_dir}/tree", pattern="name=*").collect()}
    assert len(back) == 41 and back["p=pkg 0/name=twice.py"] == "a\na\n"  # Spark reads no row from an empty file
    assert os.path.getsize(f"{tmp_dir}/tree/p=pkg 1/name=empty.py") == 0
    assert all(back[p] == c for p, c in rows[:40])


def test_source_files_are_listed_by_the_tasks(spark, tmp_dir):
    # no file is known to the driver: the plan has no file index, and names, hidden files and patterns count as for Spark's sources
    names = ["a/b/c/x.py", "a/y.py", "top.py", "_p=1/z.py", "_hidden/no.py", ".git/no.py", "a/.no.py", "a/_no.py", "a/n.txt", "_metadata/m.py",
             "a/gone.py._COPYING_", "b/q{1}.py"]
    for name in names:
        _write(f"{tmp_dir}/tree/{name}", f"# {name}\r", "w")
    _write(f"{tmp_dir}/tree/b/bytes.py", b"\xff\r\n\xe9", "wb")
    _write(f"{tmp_dir}/tree/b/empty.py", "", "w")
    for pattern in ("*.py", "{x,y}.p[a-z]", "?.py", "[^x]*.py", "q\\{1\\}.py", "*.{py,txt}"):
        df = R.read_source_files(spark, f"{tmp_dir}/tree", pattern)
        assert df.inputFiles() == []
        spark_own = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(f"{tmp_dir}/tree", wholetext=True)
        want = {(r["p"].split("/tree/", 1)[1], r["value"]) for r in spark_own.select(
            R._path_col().alias("p"), R.normalize_newlines("value").alias("value")).collect()}
        got = df.collect()
        assert want and len(got) == len(want) and {(r["path"], r["content"]) for r in got} == want
        assert all(r["package"] == r["path"].split("/")[0] for r in got)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.read_source_files(spark, f"{tmp_dir}/missing")
