"""A second run reads and rewrites only what is pending."""

import glob
import os

from pyspark.sql import functions as F

from codeloom.plans import incremental as I

PKGS = ("a", "b", "c")


def _inputs(spark, asked, empty=()):
    def make(names):
        asked.append(list(names))
        frame = lambda rows, schema: spark.createDataFrame(rows, "package string, " + schema)
        some = [p for p in names if p not in empty]
        log = [(p, k, line) for p in some for k, line in enumerate([
            "Main interprocedural analysis phase...", "2 functions will be analyzed.",
            f"[INFO] (1/2) \x1b[0mf (from /w/{p}/m.py)", f"[INFO] (2/2) \x1b[0mg (from /w/{p}/m.py)"])]
        return {
            "src": frame([(p, f"/w/{p}/m.py", "def f(x):\n    return g(x)\ndef g(x):\n    pass") for p in some], "path string, content string"),
            "entries": frame([(p, f"m.py:<module>:{x}") for p in some for x in "fg"], "function string"),
            "calls": frame([(p, "m.py:<module>:f", "m.py:<module>:g") for p in some], "caller string, callee string"),
            "log": frame(log, "line_no long, line string"),
            "roots": frame([(p, f"/w/{p}") for p in names], "root string"),
        }

    return make


def _files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/*/package=*/*.parquet")}


def _versions(spark, **versions):
    return spark.createDataFrame(list(versions.items()), "package string, version string")


def test_only_pending_packages_are_read_and_written(spark, tmp_dir):
    asked = []
    assert I.update_graph(spark, tmp_dir, _versions(spark, a="1", b="1"), _inputs(spark, asked)) == ["a", "b"]
    first = _files(tmp_dir)
    edges = lambda: sorted(map(tuple, I.read_output(spark, tmp_dir, "edges").select("package", "node1", "node2").collect()))
    assert edges() == [(p, "m.f", "m.g") for p in "ab"]
    assert I.update_graph(spark, tmp_dir, _versions(spark, a="1", b="2", c="1"), _inputs(spark, asked)) == ["b", "c"]
    assert asked == [["a", "b"], ["b", "c"]]
    second = _files(tmp_dir)
    same = {f for f in first if second.get(f) == first[f]}
    assert same == {f for f in first if "package=a/" in f}
    assert edges() == [(p, "m.f", "m.g") for p in "abc"]
    manifest = {r["package"]: (r["version"], r["status"], r["run"]) for r in I.read_manifest(spark, tmp_dir).collect()}
    assert manifest == {"a": ("1", "ok", 1), "b": ("2", "ok", 2), "c": ("1", "ok", 2)}
    assert I.update_graph(spark, tmp_dir, _versions(spark, a="1", b="2", c="1"), _inputs(spark, asked)) == []
    assert len(asked) == 2 and _files(tmp_dir) == second


def test_a_package_that_lost_its_output_keeps_nothing(spark, tmp_dir):
    I.update_graph(spark, tmp_dir, _versions(spark, a="1", b="1"), _inputs(spark, []), at_once=1)
    I.update_graph(spark, tmp_dir, _versions(spark, a="2", b="1"), _inputs(spark, [], empty=("a",)))
    for name in ("nodes", "edges"):
        assert {r["package"] for r in I.read_output(spark, tmp_dir, name).collect()} == {"b"}
    status = {r["package"]: (r["status"], r["run"]) for r in I.read_manifest(spark, tmp_dir).collect()}
    assert status == {"a": ("error", 3), "b": ("ok", 2)}


def test_written_rows_are_not_dealt_by_package_alone(spark, tmp_dir):
    own = spark.createDataFrame([("a",), ("b",)], "package string")
    rows = spark.range(0, 30000, 1, 4).select(F.lit("a").alias("package"), F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 512)).alias("node1"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200kb")
    try:
        I._replace(rows, own, f"{tmp_dir}/edges", "node1")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    # the large package is several tasks' files; the one without rows has its row of nulls
    assert len(glob.glob(f"{tmp_dir}/edges/package=a/*.parquet")) > 1
    assert I.read_output(spark, tmp_dir, "edges").count() == 30000
    back = spark.read.parquet(f"{tmp_dir}/edges")
    assert [tuple(r) for r in back.where("package = 'b'").collect()] == [(None, "b")]
