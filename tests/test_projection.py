"""The projection trained on the triplet hinge, against the same steps in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import projection as P
from codeloom.plans.evaluation import evaluate_embedder


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    w = rng.normal(size=(12, 4))
    a, p, n = (rng.normal(size=(30, 12)) for _ in range(3))
    a[0] = 0  # no direction: no gradient
    grad, loss = P.hinge_gradient(w, a, p, n)
    for i, j in ((0, 0), (5, 2), (11, 3)):
        up, down = w.copy(), w.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        slope = (P.hinge_gradient(up, a, p, n)[1] - P.hinge_gradient(down, a, p, n)[1]) / 2e-6
        assert grad[i, j] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def _corpus(spark):
    rng = np.random.default_rng(0)
    rows, edges = [], []
    for k in range(160):  # nodes of a topic link to each other; most words are noise
        words = [f"t{k % 8}"] * 2 + [f"w{x}" for x in rng.integers(0, 60, 14)]
        rows.append((f"p{k % 2}", f"n{k}", " ".join(rng.permutation(words)) if k % 40 else None, k))
        edges.append((f"p{k % 2}", k, f"n{k}", f"n{(k + 8) % 160}"))
    return (spark.createDataFrame(edges, "package string, edge_id long, node1 string, node2 string"),
            spark.createDataFrame(rows, "package string, node string, source_code string, doc_id long"))


def test_training_matches_numpy_and_lowers_the_loss(spark, tmp_dir):
    edges, nodes = _corpus(spark)
    trip = P.node_features(edges, nodes, "edge_id", "doc_id", features=512)
    rows = [[(r[f"f{k}"]["indices"], r[f"f{k}"]["values"]) for k in (1, 2, 3)] + [r["b"]] for r in trip.select(
        "*", F.pmod(P.hash_int(F.lit(42), "edge_id"), F.lit(3)).alias("b")).collect()]
    model, losses = P.train_projection(trip, "edge_id", features=512, dim=16, epochs=4, batches=3)
    w = P.first_weights(512, 16, 42)
    first = second = np.zeros_like(w)
    step, want = 0, []
    for epoch in range(4):
        for b in np.random.default_rng((42, epoch)).permutation(3):
            sides = []
            for k in range(3):
                x = np.zeros((sum(r[3] == b for r in rows), 512))
                for at, r in enumerate(r for r in rows if r[3] == b):
                    x[at, r[k][0]] = r[k][1]
                sides.append(x)
            grad, loss = P.hinge_gradient(w, *sides)
            step += 1
            want.append(loss / len(sides[0]))
            w, first, second = P.adam(w, grad / len(sides[0]), first, second, step, 0.02)
    assert losses == pytest.approx(want, rel=1e-6) and np.allclose(model.weights, w, atol=1e-6)
    assert losses[-1] < losses[0] - 0.05
    model.save(spark, f"{tmp_dir}/model")
    again = P.Projection.load(spark, f"{tmp_dir}/model")
    assert np.array_equal(again.weights, model.weights)
    text = spark.createDataFrame([("t1 w2 w3", "t1 w9", ""), ("t2", "t2 w1", "t3 w1")], "source1 string, source2 string, source3 string")
    assert evaluate_embedder(text, again).first()["triplets"] == 2
    assert P.train_projection(trip.limit(0), "edge_id", features=64, dim=4)[1] == []


def test_each_node_is_embedded_once(spark, tmp_dir):
    """The metrics are those of the triplets' texts, but a node's text meets the embedder once."""
    import pandas as pd

    from codeloom.operators import sampling as S
    from codeloom.plans.evaluation import evaluate_on_nodes

    edges, nodes = _corpus(spark)
    edges = edges.union(spark.createDataFrame([("p9", 900, "x", "y")], edges.schema)).union(edges.where("edge_id < 40"))
    met = spark.sparkContext.accumulator(0)

    def counted(df, column, out):
        @F.pandas_udf("array<double>")
        def vector(texts: pd.Series) -> pd.Series:
            met.add(len(texts))
            return texts.map(lambda x: [float(len(x)), float(x.count("t")), float(x.count("w1"))])

        return df.withColumn(out, vector(column))

    want = evaluate_embedder(S.triplets(edges, nodes, "edge_id", "doc_id"), counted).first().asDict()
    met.value = 0
    got = evaluate_on_nodes(edges, nodes, counted, "edge_id", "doc_id").first().asDict()
    assert got == pytest.approx(want) and got["triplets"] == 201
    assert met.value <= 160 + 3, met.value
