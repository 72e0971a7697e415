"""Byte-level BPE on executors: text to token ids and back.

A text is cut by the tokenizer's pattern; the distinct pieces of a batch are
encoded together in padded NumPy matrices, one per length bucket.  In each
round every row finds its leftmost pair of least rank (one ``argmin``), merges
it and closes the gap; pair ranks come from an open-addressing hash table.
Rows without a pair left drop out, so the matrices shrink in both directions.
A piece of more than ``LONGEST`` bytes is merged by the same rule over a heap
of (rank, place), where a matrix would take time in the square of its length.

Token ids travel as one binary value per text: unsigned 32-bit, little-endian.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from codeloom.llm.words import chunks, ragged, release

NONE = np.int32(2**31 - 1)
LONGEST = 1024
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONGEST)


class PairTable:
    """(left id, right id) -> id of the joined token, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, to: np.ndarray):
        self.bits = max(4, int(len(to) * 3).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.to = np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[at] == keys
            self.to[at[placed]] = to[placed]
            keys, to, at = keys[~placed], to[~placed], (at[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.to[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], (at[more] + 1) & (len(self.keys) - 1)
        return out


class Encoder:
    """The merges of one vocabulary: ``ranks`` maps token bytes to their rank, which is their id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = [
            (ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.pairs = PairTable(*np.array(cuts, np.int64).reshape(-1, 3).T)
        self.cache_size = 300_000
        self._forget()

    @classmethod
    def from_file(cls, data: bytes, pattern: str) -> Encoder:
        """From the content of a rank file: base64 token, blank, rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.first = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def merge_matrix(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length, all rows merging at once."""
        width = max(map(len, rows))
        n = len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        flat = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        ranks = np.full((n, width - 1), NONE, np.int32)
        inner = np.arange(width - 1) < lengths[:, None] - 1
        ranks[inner] = self.pairs.look_up(ids[:, :-1][inner], ids[:, 1:][inner])
        row, out = np.arange(n), [None] * n
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            here = np.arange(len(row))
            best = ranks[here, at] if ranks.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : lengths[k]]
                keep = ~done
                row, ids, ranks, lengths, at, best = row[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                here = np.arange(len(row))
                if not len(row):
                    break
            # merge at `at`: the joined token takes the place, what follows moves one to the left
            ids[here, at] = best
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            lengths = lengths - 1
            place = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            top = int(lengths.max())
            ids, ranks = ids[:, :top], ranks[:, : max(top - 1, 0)]
            for side in (at - 1, at):  # the two pairs with the joined token
                ok = np.flatnonzero((side >= 0) & (side + 1 < lengths))
                if len(ok):
                    ranks[ok, side[ok]] = self.pairs.look_up(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def merge_heap(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece by the same rule: least rank first, then leftmost."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        first = self.pairs.look_up(ids[:-1], ids[1:])
        heap = [(int(r), int(k)) for k, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        tokens = [piece[k : k + 1] for k in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))

        def rank(k):
            return self.ranks.get(tokens[k] + tokens[after[k]]) if k >= 0 and tokens[k] and after[k] < len(piece) else None

        while heap:
            r, k = heapq.heappop(heap)
            if rank(k) != r:
                continue
            gone = after[k]
            tokens[k], tokens[gone] = tokens[k] + tokens[gone], b""
            after[k] = after[gone]
            if after[k] < len(piece):
                before[after[k]] = k
            for x in (before[k], k):
                if (new := rank(x)) is not None:
                    heapq.heappush(heap, (new, x))
        return np.array([self.ranks[t] for t in tokens if t], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        by_bucket: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(p) > LONGEST:
                out[k] = self.merge_heap(p)
            else:
                by_bucket.setdefault(next(b for b in BUCKETS if len(p) <= b), []).append(k)
        for bucket, which in by_bucket.items():
            step = max(1, (1 << 19) // bucket)
            for a in range(0, len(which), step):
                part = which[a : a + step]
                for k, ids in zip(part, self.merge_matrix([pieces[x] for x in part])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; the pieces seen so far in this task's process are kept up to ``cache_size``."""
        if len(self.place) > self.cache_size:
            self._forget()
        cut = [self.pattern.findall(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.place})
        if new:
            got = self.encode_pieces([p.encode() for p in new])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
            self.length = np.concatenate((self.length, size))
            self.pool = np.concatenate((self.pool, *got))
        out = []
        for pieces in cut:
            at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
            out.append(self.pool[ragged(self.first[at], self.length[at])])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per vocabulary and worker process."""
    key = hashlib.sha1(data + pattern.encode()).digest()
    if key not in _encoders:
        _encoders[key] = Encoder.from_file(data, pattern)
    return _encoders[key]


def _free(taken, name: str) -> str:
    while name in taken:
        name += "_"
    return name


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns but the text, and ``ids_col``: the ids as little-endian unsigned 32-bit integers.

    A null text is empty; every input row gives one row.  Special tokens'
    strings are ordinary text.  ``ids_col`` replaces a column of that name.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias(_free(keep, "text")))
    schema = StructType([*source.schema.fields[:-1], StructField(ids_col, BinaryType())])

    def run(batches):
        enc = encoder(vocabulary.value, pattern)
        for b in batches:
            column = b.column(len(keep))
            for first, end, _, _ in chunks(column, 1 << 21):
                texts = [t or "" for t in column.slice(first, end - first).to_pylist()]
                ids = [x.astype("<u4").tobytes() for x in enc.encode(texts)]
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=schema.names)
            release()

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns and ``bytes_col``: the bytes that the ids stand for (null ids: null)."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    source = tokens.drop(bytes_col) if bytes_col in tokens.columns else tokens
    at = source.columns.index(ids_col)
    schema = StructType([*source.schema.fields, StructField(bytes_col, BinaryType())])

    def run(batches):
        enc = encoder(vocabulary.value, pattern)
        for b in batches:
            for first, end, _, _ in chunks(b.column(at), 1 << 22):
                part = b.slice(first, end - first)
                out = [None if x is None else enc.decode(np.frombuffer(x, "<u4")) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)
            release()

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens and the digests of its ids and of the text decoded from them."""
    ids = encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ranks_path, pattern)
    return decode(ids, ranks_path, pattern).select(
        F.col("id").alias(id_col),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
