"""Symbol, log-line and filter functions on literal rows (edge cases of the
original string rules)."""

from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions import predicates as P


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def test_strip_overload_suffix(spark):
    cases = {"m.py:<module>:f::1": "m.py:<module>:f", "f::12": "f::12", "f:1": "f:1", "f::a": "f::a", "f": "f"}
    for v, want in cases.items():
        assert _one(spark, N.strip_overload_suffix, v) == want


def test_bare_and_readable_names(spark):
    assert _one(spark, N.bare_name, "a.py:<module>:C:f") == "f"
    assert _one(spark, N.bare_name, "plain") == "plain"
    assert _one(spark, N.bare_name, "ends:") == ""
    assert _one(spark, N.readable_name, "pkg.mod.f") == "mod.f"
    assert _one(spark, N.readable_name, "nodot") == "nodot"


def test_dotted_name_rules(spark):
    assert _one(spark, N.dotted_name, "m.py:<module>:C:f") == "C.f"
    assert _one(spark, N.dotted_name, "m.py:<module>:f::1") == "f..1"
    # without <module> the original rule keeps only the last character
    assert _one(spark, N.dotted_name, "m.py:f") == "f"
    assert _one(spark, N.dotted_name, "xyz") == "z"


def test_qualified_node_and_local_module(spark):
    df = spark.createDataFrame([("src/a/m.py", "m.py:<module>:C:g", "/r/pkg", "/r/pkg/src/a/m.py")],
                               "p string, s string, root string, full string")
    r = df.select(N.qualified_node("p", "s").alias("n"), N.local_module("full", F.col("root")).alias("m")).first()
    assert r["n"] == "src/a/m.C.g"
    assert r["m"] == "src/a/m"


def test_parse_progress(spark):
    got = {v: _one(spark, N.parse_progress, v) for v in
           ["[I] (3/10) x", "(a/b)", "no parens", "(1.5/2)", "x (7/9) (1/2)", "(-1/4) y", "(12/30"]}
    assert tuple(got["[I] (3/10) x"]) == (3, 10)
    assert got["(a/b)"] is None and got["no parens"] is None and got["(1.5/2)"] is None
    assert tuple(got["x (7/9) (1/2)"]) == (7, 9)  # only the first parentheses count
    assert tuple(got["(-1/4) y"]) == (-1, 4)
    # no closing parenthesis: the last character is dropped, '12/3' remains
    assert tuple(got["(12/30"]) == (12, 3)


def test_is_number(spark):
    for v, want in {"12": True, "-3": True, "1.25": True, "1.": False, "a1": False, "": False}.items():
        assert _one(spark, N.is_number, v) is want


def test_parse_log_entry(spark):
    line = "[INFO] (4/9) \x1b[0m_helper (from /w/pkg7/src/util.py)"
    df = spark.createDataFrame([(line,), ("no from marker (1/2) here",)], "l string")
    rows = df.select(N.parse_log_entry("l", F.lit("/w/pkg7")).alias("e")).collect()
    assert rows[0]["e"]["name"] == "_helper" and rows[0]["e"]["rel_path"] == "src/util.py"
    assert rows[1]["e"] is None


def test_user_function_filters(spark):
    keep = {
        "m.py:<module>:f": True, "m.py:<module>:$$init$$": False, "m.py:<module>:x$$": False,
        "m.py:<module>:<lambda>": False, "m.py:<module>:<module>": False, "m.py:<module>:2f": False,
        "builtin.py:<module>:len": False, "m.py:<module>:": False,
    }
    for v, want in keep.items():
        assert _one(spark, P.is_user_function, v) is want, v
    # older list form: $$ on the whole symbol, last segment exactly "2"
    assert _one(spark, P.is_user_function_v1, "$$m.py:f") is False
    assert _one(spark, P.is_user_function_v1, "m.py:<module>:2") is False
    assert _one(spark, P.is_user_function_v1, "m.py:<module>:2f") is True


def test_not_builtin(spark):
    assert _one(spark, P.not_builtin, "builtin.py:<module>:len") is False
    assert _one(spark, P.not_builtin, "m.py:<module>:builtin.py") is True
    # no ':' → the last character is ignored
    assert _one(spark, P.not_builtin, "builtin.pyX") is False
    assert _one(spark, P.not_builtin, "abuiltin.p") is True


def test_extract_marked_and_fenced(spark):
    from codeloom.functions import text as T

    cases = {
        "a #to_be_implemented x #to_be_implemented\n  code()\n#end_of_example z": "code()",
        "#end_of_example before #to_be_implemented after": None,  # wrong order: whole text
        "no markers": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["m"] for r in df.select("s", T.extract_marked("s").alias("m")).collect()}
    for k, want in cases.items():
        assert got[k] == (want if want is not None else k)
    f = spark.createDataFrame([("x ```python\nprint(1)\n``` y ```python\nz\n```",), ("plain",)], "s string")
    out = [r["c"] for r in f.select(T.extract_fenced_code("s").alias("c")).collect()]
    assert out == ["\nprint(1)\n", "plain"]


def test_phase_flag_and_count_check(spark):
    from codeloom.operators import graph as G

    lines = ["(1/9) early", "Main interprocedural analysis phase...", "3 functions will be analyzed.",
             "(1/3) a", "(2/3) b"]
    log = spark.createDataFrame([("p", i, l) for i, l in enumerate(lines)], "package string, line_no long, line string")
    flags = [r["after_marker"] for r in G.phase_flag(log).orderBy("line_no").collect()]
    assert flags == [False, False, True, True, True]
    chk = G.log_count_check(G.after_marker(log)).first()
    assert (chk["expected"], chk["parsed"], chk["mismatch"]) == (3, 2, True)
