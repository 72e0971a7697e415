import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import suffixtree
from helpers import low_words

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*low_words(text), None]


def brute(rows, share, weight, least):
    """(id, held) -> n_tokens, n_known, N, base, score by the definitions, with n-grams as tuples."""
    uni, bi, tri = Counter(), Counter(), Counter()
    train = [tokens(t) for _, t, held in rows if not held]
    for w in train:
        uni.update(w)
        bi.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)
    often = max(share * n, 2)
    one = {a for a, c in uni.items() if a is not None and c >= often}
    two = {ab for ab, c in bi.items() if ab[0] in one and None not in ab and c >= often}

    def chain(w, k, use, o=0):
        p = (uni[w[k]] - o + 0.5) / (n - o + 0.5 * (v + 1))
        out = [p]
        if k >= 1 and w[k - 1] in use:
            p = (bi[w[k - 1], w[k]] - o + weight * p) / (uni[w[k - 1]] - o + weight)
            out.append(p)
            if k >= 2 and (w[k - 2], w[k - 1]) in use:
                p = (tri[w[k - 2], w[k - 1], w[k]] - o + weight * p) / (bi[w[k - 2], w[k - 1]] - o + weight)
                out.append(p)
        return out

    gain = Counter()
    for w in train:
        for k in range(1, len(w)):
            p = chain(w, k, one | two, 1)
            if len(p) > 1:
                gain[w[k - 1]] += math.log(p[1] / p[0])
            if len(p) > 2:
                gain[w[k - 2], w[k - 1]] += math.log(p[2] / p[1])
    stay = {s for s in one if gain[s] >= least * uni[s]} | {s for s in two if gain[s] >= least * bi[s]}
    out = []
    for i, t, held in rows:
        w = tokens(t)
        scores = [chain(w, k, stay) for k in range(len(w))]
        known = sum(uni[x] > 0 for x in w)
        out.append((i, bool(held), len(w), known, n, sum(math.log10(p[0]) for p in scores), sum(math.log10(p[-1]) for p in scores)))
    return out, len(stay), len(one | two)


def same(df, want):
    rows = [(r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_query_matches_brute_force_and_beats_the_base(spark):
    from codeloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in docs]
    from test_suffixtree_contexts import brute as by_length

    want, stay = by_length(rows, 7, 3, 2000.0, 0.01)
    df = QUERIES["op8_lm_scoring"](spark, SF)
    same(df, want)
    assert {len(x) for x in stay} == {1, 2, 3}
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_chunks_nulls_and_extra_columns(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice("a a a b b c the of D é x1".split()) for _ in range(rng.randrange(0, 50))), k % 5 == 1) for k in range(120)]
    rows += [(None, "a b c", False), (None, None, False), (7, "", True), (7, "", True), (300, "zz " * 20_000, False)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, held boolean, score int, _text string")
    want, _, _ = brute(rows, 1e-3, 5.0, 0.001)
    for size in (8 << 20, 2000):
        same(suffixtree.score_texts(df, F.col("held"), share=1e-3, weight=5.0, least=0.001, chunk_bytes=size), want)
    assert suffixtree.score_texts(df.limit(0), F.col("held")).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, True)], "doc_id long, text string, held boolean")
    rows = {r.doc_id: r for r in suffixtree.score_texts(df, F.lit(True)).collect()}
    assert rows[1].train_tokens == 0 and rows[1].n_known == 0 and rows[1].base_score == 0.0
    assert {r.held_out for r in suffixtree.score_texts(df, F.col("held")).collect()} == {False, True}


def test_distinct():
    import numpy as np

    rng = np.random.default_rng(1)
    close = np.array([5, 4, 5, 4, 1 << 60, (1 << 60) + 1, 1 << 60], np.uint64)  # equal but for the lowest bits
    for x in (np.empty(0, np.uint64), close, rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 5000)]):
        for a, b in zip(suffixtree._distinct(x), np.unique(x, return_inverse=True)):
            assert (a == b).all() and len(a) == len(b)
