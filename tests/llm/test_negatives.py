import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import negatives as neg

SCHEMA = "vec_id long, label int, embedding array<float>, row int, id string, rank string"


def brute(rows, is_anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    known = []
    for i, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        known.append((i, label, [math.floor(float(np.float32(x)) * scale) for x in vec]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (i, label, vec) in enumerate(known):
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(vec, w)), j, other) for m, (j, other, w) in enumerate(known) if m != k]
        best = sorted([x for x in scored if x[2] == label], key=order)[:positives]
        for p in best:
            inside = [x for x in scored if x[2] != label and low * p[0] <= 100 * x[0] <= high * p[0]]
            for rank, x in enumerate(sorted(inside, key=order)[:negatives], 1):
                out.append((i, p[1], rank, x[1], p[0], x[0]))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    df = neg.hard_negatives(df, F.col("id") % 4 == 0, **more)
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (70, 64, 130), (129, 67, 65), (256, 128, 100), (512, 33, 512)])
def test_strassen_is_exact(shape):
    i, k, j = shape
    r = np.random.default_rng(i)
    a, b = r.integers(-(2**27), 2**27, (i, k)), r.integers(-(2**27), 2**27, (k, j))
    assert (neg.strassen(a, b) == a @ b).all()
    assert (neg.strassen(a, b, leaf=2) == a @ b).all()


def test_heaps_keep_ties_by_place():
    r = np.random.default_rng(3)
    scores = r.integers(0, 4, (7, 90))
    allowed = r.random((7, 90)) < 0.5
    places = r.permutation(90)
    heaps = neg.Heaps(7, 6)
    for a, b in ((0, 30), (30, 34), (34, 90)):
        heaps.push(np.arange(7), scores[:, a:b], allowed[:, a:b], places[a:b])
    for row in range(7):
        want = sorted((-s, p) for s, p, ok in zip(scores[row], places, allowed[row]) if ok)[:6]
        mine = heaps.of == row
        assert list(zip((-heaps.score[mine]).tolist(), heaps.place[mine].tolist())) == want


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 7)])
def test_matches_brute_force(spark, blocks):
    r = np.random.default_rng(1)
    rows = [(int(i), int(r.integers(0, 3)), [float(np.float32(x)) for x in r.normal(0.2, 0.4, 9)]) for i in range(90)]
    rows += [(i, label, vec) for i, label, vec in rows[:12]]  # repeated rows
    rows += [(200 + k, k % 3, rows[5][2]) for k in range(6)]  # ties of all kinds
    rows += [(400, None, rows[0][2]), (404, 1, None), (408, 1, [1.0, None]), (412, 2, [float("nan")]), (416, 2, [float("inf")])]
    rows += [(None, 1, rows[1][2]), (None, 2, rows[2][2]), (420, 0, []), (424, 1, rows[3][2][:4])]
    got = run(spark, rows, anchor_block=blocks[0], row_block=blocks[1])
    assert got == brute(rows, lambda i: i is not None and i % 4 == 0)
    assert len(got) > 200


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, 1, [0.5])]) == []
    assert run(spark, [(4, 1, [0.0]), (5, 1, [1.0]), (6, 2, [1.0])]) == [(4, 5, 1, 6, 0, 0)]  # a positive of zero
    assert run(spark, [(4, 1, [1.0]), (5, 1, [-1.0]), (6, 2, [-0.5])]) == []  # a negative one
    assert run(spark, [(4, 1, [1e30]), (5, 1, [1.0]), (8, 2, [1.0])]) == []  # beyond 64 bits
    many = [(4, 1, [1.0])] + [(5, 1, [1.0])] * 20 + [(6, 2, [0.5])] * 20
    got = run(spark, many, row_block=6)
    assert got == sorted([(4, 5, rank, 6, 65536, 32768) for _ in range(5) for rank in range(1, 11)], key=str)
