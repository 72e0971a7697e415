"""An embedder trained on the triplet hinge: a projection of hashed token counts.

``max(0, cos(a, n) - cos(a, p) + margin)`` is lowered by mini-batch gradients.
The token counts are hashed into a fixed number of features, so no vocabulary
exists anywhere and the model's size is a parameter.  The triplets' features
are written once, dealt into batches; each step is one job over one batch:
tasks sum their rows' gradients, slices of those sums are added up in two
levels (a tree), and only the model-sized total reaches the driver, which
takes an Adam step.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import MISSING_SOURCE
from codeloom.functions.util import hash_int
from codeloom.operators import sampling as S
from codeloom.operators.embed import embed
from codeloom.operators.scoring import MARGIN
from codeloom.session import ensure_checkpoint_dir

#: Rows of dense features that a task holds at once, and features in a slice of the gradient.
ROWS, SLICE = 256, 256
#: Tasks whose slices are added up first.
FAN = 32
PART = "task int, slice int, grad binary, loss double, n long"


class Projection(NamedTuple):
    """``weights``: features x dim.  Called as ``(df, text column, out)`` it adds the embedding."""

    weights: np.ndarray

    def __call__(self, df: DataFrame, column: str, out: str) -> DataFrame:
        w = self.weights

        @F.pandas_udf("array<double>")
        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([v @ w[i] if len(i) else np.zeros(w.shape[1]) for i, v in zip(indices, values)])

        sparse = embed(df, column, out="_hashed", dim=len(w), dense=False)
        sparse = sparse.withColumn("_hashed", F.unwrap_udt("_hashed"))
        return sparse.withColumn(out, project("_hashed.indices", "_hashed.values")).drop("_hashed")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pd.DataFrame({"feature": np.arange(len(self.weights)), "weights": list(self.weights)})
        spark.createDataFrame(rows, "feature int, weights array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Projection:
        rows = spark.read.parquet(path).orderBy("feature").collect()  # the model, not data
        return cls(np.array([r["weights"] for r in rows]))


def first_weights(features: int, dim: int, seed: int) -> np.ndarray:
    """A random projection, which keeps cosines about as they are."""
    return np.random.default_rng(seed).standard_normal((features, dim)) / np.sqrt(dim)


def _cosine(u: np.ndarray, v: np.ndarray):
    """Cosines of the rows, and their gradients by ``u`` and ``v`` (zero where a row has no length)."""
    a, b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (u, v))
    ok = (a > 1e-12) & (b > 1e-12)
    a, b = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
    cos = np.where(ok, np.einsum("ij,ij->i", u, v) / (a * b), 0.0)
    by_u = np.where(ok[:, None], v / (a * b)[:, None] - u * (cos / a ** 2)[:, None], 0.0)
    by_v = np.where(ok[:, None], u / (a * b)[:, None] - v * (cos / b ** 2)[:, None], 0.0)
    return cos, by_u, by_v


def hinge_gradient(w: np.ndarray, a: np.ndarray, p: np.ndarray, n: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, float]:
    """Gradient by ``w`` and sum of the triplet hinge of rows of features."""
    u, v, z = a @ w, p @ w, n @ w
    near, near_u, near_v = _cosine(u, v)
    far, far_u, far_z = _cosine(u, z)
    loss = np.maximum(far - near + margin, 0.0)
    on = (loss > 0)[:, None]
    return a.T @ (on * (far_u - near_u)) - p.T @ (on * near_v) + n.T @ (on * far_z), float(loss.sum())


def _dense(column: pa.StructArray, features: int) -> np.ndarray:
    indices = column.field("indices")
    sizes = np.diff(indices.offsets.to_numpy())
    x = np.zeros((len(column), features))
    row = np.repeat(np.arange(len(column)), sizes)
    x[row, indices.flatten().to_numpy()] = column.field("values").flatten().to_numpy()
    return x


def _partial(w: np.ndarray, margin: float):
    def run(batches):
        total, loss, n = np.zeros_like(w), 0.0, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                # a slice of a nested column keeps its parent's buffers; taken rows have their own
                sides = [part.column(c).take(pa.array(np.arange(part.num_rows))) for c in range(3)]
                g, one = hinge_gradient(w, *(_dense(x, len(w)) for x in sides), margin)
                total += g
                loss += one
                n += part.num_rows
        if n:
            task = TaskContext.get().partitionId()
            cuts = range(0, len(w), SLICE)
            yield pa.RecordBatch.from_pydict({
                "task": pa.array([task] * len(cuts), pa.int32()), "slice": pa.array(range(len(cuts)), pa.int32()),
                "grad": pa.array([total[c:c + SLICE].tobytes() for c in cuts], pa.binary()),
                "loss": pa.array([loss if c == 0 else 0.0 for c in cuts]), "n": pa.array([n if c == 0 else 0 for c in cuts], pa.int64())})

    return run


def _added(key, table):
    """One row for the rows of a slice, added in the order of their tasks."""
    table = table.sort_by("task")
    grad = np.sum([np.frombuffer(x) for x in table.column("grad").to_pylist()], axis=0)
    first = {c: table.column(c).to_pylist()[0] for c in ("task", "slice")}
    return pa.table({
        "task": pa.array([first["task"]], pa.int32()), "slice": pa.array([first["slice"]], pa.int32()),
        "grad": pa.array([grad.tobytes()], pa.binary()), "loss": pa.array([sum(table.column("loss").to_pylist())], pa.float64()),
        "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


def gradient(batch: DataFrame, w: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, float, int]:
    """Gradient, summed loss and number of rows of ``batch`` (three unwrapped sparse vectors a row); one job."""
    parts = batch.mapInArrow(_partial(w, margin), PART)
    parts = parts.withColumn("fan", F.floor(F.col("task") / FAN))
    parts = parts.groupBy("slice", "fan").applyInArrow(_added, PART).groupBy("slice").applyInArrow(_added, PART)
    rows = sorted(parts.collect(), key=lambda r: r["slice"])  # as large as the model
    if not rows:
        return np.zeros_like(w), 0.0, 0
    grad = np.concatenate([np.frombuffer(r["grad"]).reshape(-1, w.shape[1]) for r in rows])
    return grad, sum(r["loss"] for r in rows), sum(r["n"] for r in rows)


def node_features(edges: DataFrame, nodes: DataFrame, id_col: str, order: str, seed: int = 42, epoch: int = 0,
                  features: int = 4096) -> DataFrame:
    """``id_col, f1, f2, f3``: hashed features of each edge's ends and of a drawn negative.

    Each node's text is hashed once; a missing one counts as the missing-source word.
    """
    spark = nodes.sparkSession
    hashed = lambda df, c: embed(df, c, out="value", dim=features, dense=False).withColumn("value", F.unwrap_udt("value"))
    values = hashed(S.node_sources(nodes, order), "source").select("package", "node", "value")
    missing = hashed(spark.range(1).select(F.lit(MISSING_SOURCE).alias("source")), "source").select("value").scalar()
    drawn = S.draw_negatives(edges, nodes, id_col, order, seed, epoch).where("node3 is not null")
    return S.attach_node_values(drawn, values, {f"node{k}": f"f{k}" for k in (1, 2, 3)}, missing).select(id_col, "f1", "f2", "f3")


def train_projection(triplets: DataFrame, id_col: str, features: int = 4096, dim: int = 64, epochs: int = 3, batches: int = 4,
                     rate: float = 0.02, margin: float = MARGIN, seed: int = 42) -> tuple[Projection, list[float]]:
    """Fit a :class:`Projection` to ``triplets`` (``id_col, f1, f2, f3`` of :func:`node_features`).

    Returns it with each step's mean loss before the step.  ``epochs * batches``
    jobs; a batch is a seeded share of the triplets, so more data are larger
    batches (or more of them, if the caller says so).
    """
    path = f"{ensure_checkpoint_dir(triplets.sparkSession).rstrip('/')}/triplets-{uuid.uuid4().hex}"
    dealt = triplets.select("f1", "f2", "f3", F.pmod(hash_int(F.lit(seed), id_col), F.lit(batches)).cast("int").alias("batch"))
    dealt.write.partitionBy("batch").parquet(path)
    staged = triplets.sparkSession.read.schema(dealt.schema).parquet(path)
    w = first_weights(features, dim, seed)
    first, second, losses, step = np.zeros_like(w), np.zeros_like(w), [], 0
    for epoch in range(epochs):
        for b in np.random.default_rng((seed, epoch)).permutation(batches).tolist():
            grad, loss, n = gradient(staged.where(F.col("batch") == b).select("f1", "f2", "f3"), w, margin)
            if not n:
                continue
            step += 1
            losses.append(loss / n)
            w, first, second = adam(w, grad / n, first, second, step, rate)
    return Projection(w), losses


def adam(w, grad, first, second, step: int, rate: float):
    """One step of Adam with its usual constants."""
    first = 0.9 * first + 0.1 * grad
    second = 0.999 * second + 0.001 * grad ** 2
    return w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8), first, second
