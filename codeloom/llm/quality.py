"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed terms: its words, the shapes of its words
(which kinds of characters follow each other), the shapes of neighbouring
words, and whether a word repeats the one before it.  Damped and weighted by
inverse document frequency, the counts are projected on the leading singular
directions of a bounded sample of labelled texts.  The sample's vectors are
sent to all tasks; every document takes its exact cosines with all of them, in
blocks, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codeloom.llm.words import LOWER, chunks, hashes, mix, release, spans

WORDS, SHAPES, PAIRS, FLAGS = 4096, 1024, 2048, 2
TERMS = WORDS + SHAPES + PAIRS + FLAGS
#: Texts counted at once: a dense row has TERMS places.
ROWS = 128
#: Kinds of bytes in a shape: capitals, other letters, digits; any other byte is its own kind.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = ord("A")
_KIND[0x61:0x7B] = ord("a")
_KIND[0x80:] = ord("a")
_KIND[0x30:0x3A] = ord("0")


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and term number of every term that occurs."""
    text = np.repeat(np.arange(len(word) - 1), np.diff(word))
    h = hashes(LOWER[data], starts, ends)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    place = np.concatenate(([0], np.cumsum(new)))
    shape = hashes(kind[new], place[starts], place[ends])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    both = np.flatnonzero(text[1:] == text[:-1])
    pair = mix(shape[both] * np.uint64(3) + shape[both + 1])
    terms = [
        (h & np.uint64(WORDS - 1)).astype(np.int64),
        WORDS + (shape & np.uint64(SHAPES - 1)).astype(np.int64),
        WORDS + SHAPES + (pair & np.uint64(PAIRS - 1)).astype(np.int64),
        WORDS + SHAPES + PAIRS + again,
    ]
    return np.concatenate((text, text, text[both], text)), np.concatenate(terms)


def counts(column: pa.Array):
    """(first row, damped term frequencies: texts x TERMS) for one row range of ``column`` after another."""
    for first, end, data, offsets in chunks(column, 1 << 20):
        for a in range(0, end - first, ROWS):
            off = offsets[a : min(a + ROWS, end - first) + 1]
            part = data[off[0] : off[-1]]
            starts, ends, word = spans(part, off - off[0])
            n = len(off) - 1
            if not len(starts):
                yield first + a, np.zeros((n, TERMS), np.float32)
                continue
            text, term = _terms(part, starts, ends, word)
            x = np.bincount(text * TERMS + term, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
            x /= np.maximum(np.diff(word), 1)[:, None]
            yield first + a, np.sqrt(x)


class Neighbours:
    """Latent-semantic vectors of labelled texts, and the projection that made them."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int, k: int):
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32)
        x *= self.idf
        rng = np.random.default_rng(0)
        basis = np.linalg.qr(x.T @ rng.standard_normal((len(x), min(len(x), dimensions + 16)), np.float32))[0]
        for _ in range(4):  # subspace iteration
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
        self.basis = np.ascontiguousarray((basis @ turn.T)[:, :dimensions])
        self.vectors = self._unit(x @ self.basis)
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean())
        self.k = min(k, len(x))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Share of label 1 among the nearest, each weighted by its squared similarity; ties all vote."""
        out = np.full(len(column), self.prior)
        for first, x in counts(column):
            v = self._unit((x * self.idf) @ self.basis)
            cosine = v @ self.vectors.T
            edge = np.partition(cosine, -self.k, axis=1)[:, -self.k, None]
            weight = np.where(cosine >= edge, np.maximum(cosine, 0), 0).astype(np.float64) ** 2
            total = weight.sum(axis=1)
            some = total > 0
            out[first : first + len(x)][some] = (weight[some] @ self.labels) / total[some]
        return np.clip(out, 0, 1)


def held_out(id_col: str, remainder: int, folds: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == remainder, F.lit(False))


def _sample(docs, labels, id_col, text_col, label_col, per_label):
    """Term counts of at most ``per_label`` labelled texts for each label, chosen by a hash of the id.

    An id counts once, with the label that most of its rows have (0 if as many
    have either) and the first of its texts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, 1, 3)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    rows = F.broadcast(chosen[0].union(chosen[1])).join(texts, "id").groupBy("id").agg(F.first("y").alias("y"), F.min("t").alias("t"))

    def run(batches):
        for b in batches:
            place, value = [], []
            for _, x in counts(b.column(1)):
                for row in x:
                    at = np.flatnonzero(row)
                    place.append(at.astype(np.int32).tobytes())
                    value.append(row[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place, pa.binary()), pa.array(value, pa.binary())], names=["y", "place", "value"])

    got = rows.select("y", "t").mapInArrow(run, "y int, place binary, value binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.place), bytes(r.value)))  # the fit does not depend on the order of arrival
    x = np.zeros((len(got), TERMS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r.place, np.int32)] = np.frombuffer(r.value, np.float32)
    return x, np.array([r.y for r in got], np.int64)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 2000,
    dimensions: int = 64,
    k: int = 15,
) -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.5).

    The model is fitted on at most ``per_label`` texts of each label (the bound
    of the sample) with ids outside the held-out fold; every row is scored from
    its text alone.

    * Null, empty or wordless text: the share of label 1 in the sample.
    * Labels that are null or neither 0 nor 1 teach nothing; without any, every
      score is 0.5.  Null ids are scored, too.
    * Columns named score or predicted are replaced.  Empty table: empty result.
    """
    docs = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns])
    x, y = _sample(docs, labels, id_col, text_col, label_col, per_label)
    model = docs.sparkSession.sparkContext.broadcast(Neighbours(x, y, dimensions, k) if len(y) else None)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, 0.5) if model.value is None else model.value.scores(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=schema.names)
            release()

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
