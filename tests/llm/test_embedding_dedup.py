import numpy as np

from codeloom.llm import embedding_dedup
from helpers import roots

SF = "/root/testdata/sf0.1"


def brute(rows, t=0.93):
    """id -> (links, component) for distinct ids."""
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            ok[i] = label, a / np.linalg.norm(a)
    ids = sorted(ok)
    links = []
    for label in {x for x, _ in ok.values()}:
        own = [i for i in ids if ok[i][0] == label]
        for size in {len(ok[i][1]) for i in own}:
            same = [i for i in own if len(ok[i][1]) == size]
            m = np.stack([ok[i][1] for i in same])
            a, b = np.nonzero(np.triu(m @ m.T >= t, 1))
            links += [(same[x], same[y]) for x, y in zip(a, b)]
    root = roots([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i]) for i in n}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_recall(spark):
    from codeloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    have = got(QUERIES["op9_embedding_near_dedup"](spark, SF))
    assert set(have) == set(want)
    found, true = sum(x[0] for x in have.values()), sum(x[0] for x in want.values())
    assert 0.97 * true <= found <= true and all(have[i][0] <= want[i][0] for i in want)
    assert all(k == (i == c) for i, (_, c, k) in have.items())
    assert sum(have[i][1] == want[i][1] for i in want) > 0.98 * len(want)


def test_dense_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(12)
    rows, i = [], 0
    for label in (1, 2):
        centre = rng.standard_normal(16)
        for _ in range(150):  # more than any list holds
            rows.append((i, (centre + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
            i += 1
        for _ in range(200):
            rows.append((i, rng.standard_normal(16).astype(np.float32).tolist(), label))
            i += 1
    rows += [(i + k, rows[3][1], 1) for k in range(20)] + [(i + 20, [2 * x for x in rows[5][1]], 1)]
    i += 21
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(i + k, v, 1) for k, v in enumerate(odd)] + [(i + 50, rows[3][1], None), (i + 51, rows[3][1], 3)]
    df = spark.createDataFrame([(*r, 0, "m") for r in rows], "vec_id long, embedding array<float>, label int, node int, m string")
    want = brute(rows)
    for block in (1024, 40):
        have = got(embedding_dedup.near_duplicates(df, block=block))
        assert {k: v[:2] for k, v in have.items()} == want


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.001], 1), (None, [0.0, 1.0], 1), (6, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    out = sorted(embedding_dedup.near_duplicates(df).collect(), key=str)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == [("5", 1, "5"), ("6", 0, "6"), ("None", 0, "None"), ("None", 1, "5")]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []
