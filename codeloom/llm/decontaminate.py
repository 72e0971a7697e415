"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct word shingles into classes
of at most S = 16, 32, 64, ... shingles; a repetitive item, which is longer than
these, is in the class of its length, too.  For a class, a document is read as windows
of 2 S shingles, one every S, so that an item lying anywhere in a document of
any length meets a domain of its own size.  Items and windows get a one-
permutation MinHash of ``BINS`` bins; an item and a document are candidates
when one bin minimum is equal.  Each candidate is then verified on the words
themselves: the share of the item's distinct shingles found anywhere in the
document.

The items are the query set: they are sent to the tasks in blocks of a fixed
number of bytes, and the documents are scanned once for each block, without a
shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from codeloom.llm.words import chunks, hashes, ragged, release, sequence_hashes, spans

BINS_BITS = 6
BINS = 1 << BINS_BITS
LEAST = 16
#: Items of so few shingles have too few bins for a wide window: their windows are single shingles.
FEW = 8
NEVER = np.uint64(2**64 - 1)
MARKS = 1 << 22


def _minima(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash: least value for each group and bin; empty bins hold NEVER."""
    out = np.full(groups * BINS, NEVER, np.uint64)
    np.minimum.at(out, group * BINS + (values >> np.uint64(64 - BINS_BITS)).astype(np.int64), values)
    return out.reshape(groups, BINS)


def _shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n))))


class ItemBlock:
    """Signatures of one block of test items, by (shingle length, size class)."""

    def __init__(self, texts: list[bytes], shingle: int, threshold: float):
        self.threshold = threshold
        self.sets: list[set] = []
        self.length: list[int] = []
        classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, text in enumerate(texts):
            words = text.split()
            n = min(shingle, len(words))
            self.sets.append(_shingles(words, n) if n else set())
            self.length.append(n)
            if n:
                for size in {self._size(len(self.sets[k])), self._size(len(words) - n + 1)}:
                    classes[n, size].append(k)
        self.classes = {key: self._signatures(key[0], which) for key, which in classes.items()}

    @staticmethod
    def _size(count: int) -> int:
        size = 1 if count <= FEW else LEAST
        while size > 1 and size < count:
            size *= 2
        return size

    def _signatures(self, n: int, which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, items = [], []
        for k in which:
            rows = [b" ".join(s) for s in self.sets[k]]
            data = np.frombuffer(b"\n".join(r for r in rows), np.uint8)
            starts, ends, _ = spans(data, np.array([0, len(data)]))
            h = sequence_hashes(hashes(data, starts, ends), n)[::n]  # each row has n words
            least = _minima(h, np.zeros(len(h), np.int64), 1)[0]
            least = least[least != NEVER]
            values.append(least)
            items.append(np.full(len(least), k))
        values, items = np.concatenate(values), np.concatenate(items)
        order = np.argsort(values, kind="stable")
        marks = np.zeros(MARKS, bool)
        marks[(values & np.uint64(MARKS - 1)).astype(np.int64)] = True
        return values[order], items[order], marks

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs with an equal bin minimum; ``h``: word hashes, ``first``: each text's first word."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(first)
        by_length: dict[int, tuple] = {}
        for (n, size), (values, items, marks) in self.classes.items():
            if n not in by_length:
                runs = np.maximum(counts - n + 1, 0)
                by_length[n] = runs, sequence_hashes(h, n)[ragged(first[:-1], runs)]
            runs, own = by_length[n]
            if not len(own):
                continue
            blocks = -(-runs // size)
            offset = np.concatenate(([0], np.cumsum(blocks)))
            text = np.repeat(np.arange(len(runs)), blocks)
            place = ragged(np.zeros(len(runs), np.int64), runs)
            least = _minima(own, np.repeat(offset[:-1], runs) + place // size, int(offset[-1]))
            if size > 1:  # a window is a block and the next one of the same text
                same = text[1:] == text[:-1]
                least[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
            flat = least.ravel()
            at = np.flatnonzero(marks[(flat & np.uint64(MARKS - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(values, flat[at]), np.searchsorted(values, flat[at], "right")
            pair = np.repeat(text[at // BINS], hi - lo), items[ragged(lo, hi - lo)]
            found.update(zip(pair[0].tolist(), pair[1].tolist()))
        return found

    def verified(self, text: bytes, which: list[int]):
        """(item, shared shingles, item's shingles) of those items that the text contains."""
        words = text.split()
        own: dict[int, set] = {}
        for k in which:
            n = self.length[k]
            if n not in own:
                own[n] = _shingles(words, n)
            shared = len(self.sets[k] & own[n])
            if shared >= self.threshold * len(self.sets[k]):
                yield k, shared, len(self.sets[k])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document row and item it contains: ids, ``shared``, ``item_shingles``, ``containment``.

    Words are runs of letters, marks and digits in lower case, so that a passage
    is found whatever its capitals and punctuation have become.  Containment is
    the share of the item's distinct shingles that occur in the document.

    * An item of fewer words than ``shingle`` is one shingle of all its words;
      a null or empty item is contained nowhere.
    * A null text is empty.  Null ids and repeated rows stay as they are.
    * No items or no documents: empty result.
    """
    spark = docs.sparkSession
    item_id = items.schema[item_col].dataType
    schema = StructType(
        [
            StructField(id_col, docs.schema[id_col].dataType),
            StructField(item_col, item_id),
            StructField("shared", LongType()),
            StructField("item_shingles", LongType()),
            StructField("containment", DoubleType()),
        ]
    )
    source = docs.select(F.col(id_col).alias("id"), _plain(text_col))
    asked = items.select(F.col(item_col).alias("id"), _plain(item_text))
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    results = []
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == k).collect()
        if rows:
            results.append(_scan(spark, source, rows, schema, item_id, shingle, threshold))
    out = results[0] if results else spark.createDataFrame([], schema)
    for more in results[1:]:
        out = out.union(more)
    return out


def _plain(column: str):
    """Lower case, one blank for whatever is no letter, mark or digit."""
    return F.regexp_replace(F.lower(F.col(column).cast("string")), r"[^\p{L}\p{M}\p{N}]+", " ").cast("binary").alias("t")


def _scan(spark, source, rows, schema, item_id, shingle, threshold):
    sent = spark.sparkContext.broadcast(([r.id for r in rows], [bytes(r.t or b"") for r in rows]))

    def run(batches):
        ids, texts = sent.value
        block = ItemBlock(texts, shingle, threshold)
        for b in batches:
            rows, found = [], []
            for first, end, data, offsets in chunks(b.column(1)):
                starts, ends, word = spans(data, offsets)
                which = defaultdict(list)
                for text, item in block.candidates(hashes(data, starts, ends), word):
                    which[text].append(item)
                for text in sorted(which):
                    for hit in block.verified(data[offsets[text] : offsets[text + 1]].tobytes(), sorted(which[text])):
                        rows.append(first + text)
                        found.append(hit)
            release()
            if rows:
                kind = pa.array([ids[k] for k, _, _ in found], schema_type)
                shared, size = np.array([s for _, s, _ in found]), np.array([n for _, _, n in found])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), kind, pa.array(shared), pa.array(size), pa.array(shared / size)], names=schema.names
                )

    schema_type = to_arrow_type(item_id)
    return source.mapInArrow(run, schema)
