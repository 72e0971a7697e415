"""Code metrics against a plain-Python restatement of the definitions."""

import math
from collections import Counter

import pytest

from codeloom.operators import codemetrics as CM


def _toks(s):
    return s.replace("\t", " ").replace("\n", " ").replace("\r", " ").split()


def _bleu(ref, cand, weighted=False):
    r, c = _toks(ref), _toks(cand)
    logs, hit1 = [], 0
    for n in range(1, 5):
        cg = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
        rg = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        w = (lambda g: 1.0 if g[0] in CM.PYTHON_KEYWORDS else 0.2) if (weighted and n == 1) else (lambda g: 1.0)
        hit = sum(w(g) * min(k, rg[g]) for g, k in cg.items())
        tot = sum(w(g) * k for g, k in cg.items()) or 1.0
        if n == 1:
            hit1 = hit
        logs.append(math.log(0.1 / tot if hit == 0 else hit / tot))
    if hit1 == 0:
        return 0.0
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / max(len(c), 1))
    return math.exp(sum(logs) / 4) * bp


PAIRS = [
    (1, "def f(x):\n    return x + 1", "def f(x):\n    return x + 1"),
    (2, "def f(x):\n    return x + 1", "def g(y): return y - 1 if y else None"),
    (3, "for i in range(10): print(i)", "while True: pass"),
    (4, "a b c d e f", "a b"),
    (5, "x", "y z w"),
    (6, "return None", "return None if x else None"),
]


@pytest.mark.parametrize("weighted", [False, True])
def test_ngram_match_matches_definition(spark, weighted):
    df = spark.createDataFrame(PAIRS, "id long, reference string, candidate string")
    got = {r["id"]: r["score"] for r in CM.ngram_match(df, ["id"], weighted=weighted).collect()}
    for i, ref, cand in PAIRS:
        assert got[i] == pytest.approx(_bleu(ref, cand, weighted), abs=1e-9), i


def test_ast_match_and_codebleu(spark):
    rows = [
        (1, "def f(a):\n    b = a + 1\n    return b", "def f(a):\n    b = a + 1\n    return b"),
        (2, "def f(a):\n    b = a + 1\n    return b", "def (:"),
        (3, "x = 1", "y = 2"),
        (4, "def f(a):\n    b = a * 2\n    return b", "def g(q):\n    r = q * 2\n    return r"),
    ]
    df = spark.createDataFrame(rows, "id long, reference string, candidate string")
    got = {r["id"]: r for r in CM.ast_match(df, ["id"]).collect()}
    assert got[1]["syntax_match_score"] == 1.0 and got[1]["dataflow_match_score"] == 1.0
    assert got[2]["syntax_match_score"] == 0.0 and got[2]["parsed"] is False
    assert got[3]["dataflow_match_score"] is None  # no edge in the reference
    # names do not matter: renamed code matches fully
    assert got[4]["syntax_match_score"] == 1.0 and got[4]["dataflow_match_score"] == 1.0
    full = {r["id"]: r for r in CM.score_pairs(df, ["id"]).collect()}
    assert full[1]["codebleu"] == pytest.approx(1.0) and full[1]["n_parts"] == 4
    assert full[3]["n_parts"] == 3


def test_generation_metrics_population_std(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 3.0), ("d", None)], "dataset_name string, m double")
    r = CM.generation_metrics(df, ["dataset_name"], ["m"]).first()
    assert r["mean"] == 2.0 and r["std"] == 1.0


def test_report_rows(spark):
    cmp = spark.createDataFrame([("codebleu", 0.1234, 0.1), ("levenshtein_distance", 5.0, 6.0)],
                                "metric string, trained double, not_trained double")
    rows = CM.report_rows(cmp).collect()
    assert len(rows) == 1 and rows[0]["line"] == "CodeBLEU & 12.3\\% & 10.0\\% \\\\"


def test_deep_texts_leave_the_job_running(spark):
    """Texts too deep for a recursive walk or for the parser do not end the job."""
    deep = "x = " + "+".join(["a"] * 3000)
    deeper = "x = " + "-" * 20_000 + "1"
    rows = [(1, "x = 1", "x = 1"), (2, deep, deep), (3, deeper, "x = 1"), (4, "x = 1", "(" * 5000), (5, "\0", "x = 1")]
    df = spark.createDataFrame(rows, "id long, reference string, candidate string")
    got = {r["id"]: r for r in CM.ast_match(df, ["id"]).collect()}
    assert got[1]["parsed"] and got[1]["syntax_match_score"] == 1.0
    assert len(got) == 5 and not got[3]["parsed"] and not got[4]["parsed"] and not got[5]["parsed"]
    assert got[2]["syntax_match_score"] == (1.0 if got[2]["parsed"] else 0.0)
    assert CM.score_pairs(df, ["id"]).count() == 5


def test_ngram_scores_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b c", "a b d")], "id long, reference string, candidate string")
    plan = CM.ngram_scores(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_variants_may_share_signatures(spark):
    """Scores stay with their own variant though the ids repeat."""
    from codeloom.plans.evaluation import score_generations

    code = "def f(a):\n    return a"
    rows = [("d", "trained", "f", code, code), ("d", "not_trained", "f", code, code + "xyz"), ("d", "trained", "g", code, None)]
    df = spark.createDataFrame(rows, "dataset_name string, variant string, signature string, reference string, candidate string")
    got = {r["variant"]: (r["mean"], r["std"]) for r in score_generations(df, ["signature"]).collect() if r["metric"] == "levenshtein_distance"}
    assert got == {"trained": (0.0, 0.0), "not_trained": (3.0, 0.0)}
