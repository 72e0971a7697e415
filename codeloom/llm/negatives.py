"""Hard-negative mining by exact integer products of anchors and candidates.

Vectors are quantised to integers.  Anchors and candidates are dealt into blocks
of bounded size, and every pair of blocks is a tile that one task multiplies: a
tile's int64 matrices are padded with zeros and multiplied by Strassen's
recursion (seven products and integer additions, exact).  A first pass keeps
heaps of each anchor's best rows of its own label, the positives; a second pass
keeps, for each anchor and positive, the heap of the best rows of other labels
whose score lies in the positive's window.  Heaps of sub-tiles, of tiles and of
tasks are merged by the same rule, so no list of all scores is ever kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.staging import stage

LEAF = 32
SUB = 512
#: Squared norm up to which a hundredfold product of two rows fits in 64 bits.
MOST = 2.0**56
HEAP = "anchor long, slot int, score long, id long, row long"


def _power(n: int, depth: int) -> int:
    step = 1 << depth
    return -(-n // step) * step


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices; sides are padded with zeros so that every level halves them."""
    depth = 0
    while min(a.shape[0], a.shape[1], b.shape[1]) >> depth > leaf:
        depth += 1
    if not depth:
        return a @ b
    rows, inner, cols = (_power(n, depth) for n in (*a.shape, b.shape[1]))
    whole_a, whole_b = np.zeros((rows, inner), np.int64), np.zeros((inner, cols), np.int64)
    whole_a[: a.shape[0], : a.shape[1]] = a
    whole_b[: b.shape[0], : b.shape[1]] = b
    return _halved(whole_a, whole_b, depth)[: a.shape[0], : b.shape[1]]


def _halved(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    depth -= 1
    m1 = _halved(a11 + a22, b11 + b22, depth)
    m2 = _halved(a21 + a22, b11, depth)
    m3 = _halved(a11, b12 - b22, depth)
    m4 = _halved(a22, b21 - b11, depth)
    m5 = _halved(a11 + a12, b22, depth)
    m6 = _halved(a21 - a11, b11 + b12, depth)
    m7 = _halved(a12 - a22, b21 + b22, depth)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out


class Heaps:
    """The ``k`` best entries of each of ``n`` heaps: higher scores first, ties by the place of the candidate."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.of = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.place = np.empty(0, np.int64)
        #: A score below its entry here cannot enter a heap that is full.
        self.least = np.full(n, np.iinfo(np.int64).min)

    def merge(self, of: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        of, score, place = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.place, place)))
        order = np.lexsort((place, -score, of))
        of = of[order]
        first = np.searchsorted(of, of)
        keep = np.arange(len(of)) - first < self.k
        order = order[keep]
        self.of, self.score, self.place = of[keep], score[order], place[order]
        last = np.flatnonzero(np.arange(len(self.of)) - np.searchsorted(self.of, self.of) == self.k - 1)
        self.least[self.of[last]] = self.score[last]

    def push(self, of: np.ndarray, scores: np.ndarray, allowed: np.ndarray, places: np.ndarray) -> None:
        """Offer a matrix of scores, its rows to the heaps ``of`` and its columns at ``places``."""
        allowed = allowed & (scores >= self.least[of][:, None])
        if scores.shape[1] > self.k:  # whatever lies below a row's own k-th best cannot enter either
            shown = np.where(allowed, scores, np.iinfo(np.int64).min)
            bound = np.partition(shown, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            allowed &= scores >= bound[:, None]
        r, c = np.nonzero(allowed)
        if len(r):
            self.merge(of[r], scores[r, c], places[c])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=1))


def _tile(anchors: pa.Table, rows: pa.Table):
    """Anchors by label, candidates by label and id (without id last), and both matrices."""
    anchors = anchors.sort_by([("label", "ascending"), ("row", "ascending")])
    rows = rows.append_column("without", rows.column("id").is_null())
    rows = rows.sort_by([("label", "ascending"), ("without", "ascending"), ("id", "ascending"), ("row", "ascending")])
    width = max(_width(anchors.column("vec")), _width(rows.column("vec")))
    return anchors, rows, _matrix(anchors.column("vec"), width), _matrix(rows.column("vec"), width)


def _by_id(rows: pa.Table) -> np.ndarray:
    """Each candidate's place in the order that breaks ties: by id, those without one last."""
    order = rows.append_column("at", pa.array(np.arange(rows.num_rows)))
    order = order.select(["without", "id", "row", "at"]).sort_by([("without", "ascending"), ("id", "ascending"), ("row", "ascending")])
    place = np.empty(rows.num_rows, np.int64)
    place[order.column("at").to_numpy()] = np.arange(rows.num_rows)
    return place


def _entries(heaps: Heaps, anchor: np.ndarray, slot: np.ndarray, rows: pa.Table, place: np.ndarray) -> pa.Table:
    at = np.argsort(place)[heaps.place]  # back from the place in the order to the candidate
    return pa.table(
        {
            "anchor": pa.array(anchor),
            "slot": pa.array(slot.astype(np.int32)),
            "score": pa.array(heaps.score),
            "id": rows.column("id").take(pa.array(at)).combine_chunks(),
            "row": rows.column("row").take(pa.array(at)).combine_chunks(),
        }
    )


def _blocks(n: int):
    return [(k, min(k + SUB, n)) for k in range(0, n, SUB)]


def _runs(labels: np.ndarray) -> dict:
    values, first, n = np.unique(labels, return_index=True, return_counts=True)
    return {v: (a, a + c) for v, a, c in zip(values.tolist(), first.tolist(), n.tolist())}


def _positives(k: int):
    def run(key, anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return pa.table([[], [], [], [], []], schema=_HEAP)
        anchors, rows, a, b = _tile(anchors, rows)
        place = _by_id(rows)
        own, other = anchors.column("row").to_numpy(), rows.column("row").to_numpy()
        heaps = Heaps(len(a), k)
        theirs = _runs(rows.column("label").to_numpy())
        for label, (first, end) in _runs(anchors.column("label").to_numpy()).items():
            start, stop = theirs.get(label, (0, 0))
            for i, j in _blocks(end - first):
                for c, d in _blocks(stop - start):
                    x, y = slice(first + i, first + j), slice(start + c, start + d)
                    allowed = own[x][:, None] != other[y][None, :]
                    heaps.push(np.arange(x.start, x.stop), strassen(a[x], b[y].T), allowed, place[y])
        return _entries(heaps, own[heaps.of], np.zeros(len(heaps.of)), rows, place)

    return run


def _negatives(k: int, low: int, high: int):
    def run(key, anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return pa.table([[], [], [], [], []], schema=_HEAP)
        anchors, rows, a, b = _tile(anchors, rows)
        place = _by_id(rows)
        label, theirs = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
        own = anchors.column("row").to_numpy()
        wanted = anchors.column("scores").to_pylist()
        slots = max(map(len, wanted))
        positive = np.array([x + [0] * (slots - len(x)) for x in wanted], np.int64).reshape(len(a), slots)
        there = np.array([len(x) for x in wanted])
        heaps = Heaps(len(a) * slots, k)
        for i, j in _blocks(len(a)):
            for c, d in _blocks(len(b)):
                scores = strassen(a[i:j], b[c:d].T)
                different = label[i:j, None] != theirs[None, c:d]
                for s in range(slots):
                    p = positive[i:j, s][:, None]
                    window = (low * p <= 100 * scores) & (100 * scores <= high * p) & different & (there[i:j, None] > s)
                    heaps.push(np.arange(i, j) * slots + s, scores, window, place[c:d])
        return _entries(heaps, own[heaps.of // slots], heaps.of % slots, rows, place)

    return run


_HEAP = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best entries of the tasks' heaps of each anchor and slot, with their rank from 1."""
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def quantised(rows: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """id, label, vec (floor of ``scale`` times each component) of the rows that take part."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)) <= MOST
    known = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))
    known = known.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(fine, F.lit(False))).where(small)
    return known.withColumn("vec", F.transform("vec", lambda x: F.floor(x).cast("long")))


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vec_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchor_block: int = 2048,
    row_block: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score for an anchor is the inner product of their components, each
    ``floor(scale * x)``; higher scores come first, ties by smaller id.
    ``anchors`` is a condition on ``id`` (of type long).  An anchor's positives are
    its ``positives`` best other rows of its label; for each of them the
    ``negatives`` best rows of other labels are returned whose score lies between
    ``low`` and ``high`` per cent of the positive's, ``rank`` counting from 1.

    * Rows with a null label, a null vector or a null or non-finite component take
      no part, nor do vectors whose scaled squared norm exceeds 2**56 (their
      products would not fit in 64 bits).  Vectors of unequal length are filled up
      with zeros; an empty vector scores zero.
    * A null id is never an anchor's and stands behind all others in ties.
    * Repeated rows are different rows: each is an anchor, a positive and a
      negative of its own.
    * Positives of zero have a window of zero alone, negative ones an empty window.
    * Other columns are not looked at.  Empty table: empty result.
    """
    label = F.col("label") if label is None else label
    known = quantised(rows, id_col, label, vec_col, scale)
    known = stage(known.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec"), "rows")
    asked = known.where(anchors)
    n = known.agg(F.count("*"), F.count(F.when(anchors, 1))).first()
    row_blocks, anchor_blocks = max(1, -(-n[0] // row_block)), max(1, -(-n[1] // anchor_block))

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(of)).cast("long")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    def tiles(some: DataFrame, run) -> DataFrame:
        some = some.select(*(F.col(c).alias(c) for c in some.columns))  # columns of their own beside those of ``known``
        left = dealt(some, "a", anchor_blocks, "b", row_blocks).groupBy("a", "b")
        right = dealt(known, "b", row_blocks, "a", anchor_blocks).groupBy("a", "b")
        return left.cogroup(right).applyInArrow(run, HEAP)

    best = _merged(tiles(asked, _positives(positives)), positives)
    best = stage(best.select("anchor", F.col("rank").alias("slot"), "score", "id"), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda x: x["score"])  # at most ``positives``
    with_scores = asked.join(best.groupBy(F.col("anchor").alias("row")).agg(scores.alias("scores")), "row")
    found = _merged(tiles(with_scores, _negatives(negatives, low, high)), negatives)
    named = best.select("anchor", (F.col("slot") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    return (
        found.join(named, ["anchor", "slot"])
        .join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
