"""Packed token-id output: best-fit-decreasing with a segment tree over capacities.

Documents are dealt into shards of bounded size by a hash of their id.  In a
shard every text becomes token ids; a document longer than a sequence is split
into pieces that lose nothing.  Pieces go in order of falling length into the
open sequence with the least room that still holds them; a segment tree over
the possible capacities finds it.  Each sequence is written as a row of the id
matrix with its cumulative segment lengths and positions that start again with
every segment.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.words import release

PACKED = "shard long, sequence int, n_tokens int, segments array<struct<{id}: {kind}, piece: int, start: long, length: int>>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """Open sequences by free capacity: find the least capacity of at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the tightest fit, if there is one."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node //= 2  # up, until something lies to the right
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down, to the left first
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        which = self.bins[capacity].pop()
        while node:
            self.count[node] -= 1
            node //= 2
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The sequence of each piece (lengths from 1 to ``size``), and how many sequences there are."""
    where = np.zeros(len(lengths), np.int64)
    room, used = Capacities(size), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = room.take(n)
        if found is None:
            capacity, which = size, used
            used += 1
        else:
            capacity, which = found
        where[k] = which
        if capacity > n:
            room.put(capacity - n, which)
    return where, used


_encodings: dict[bytes, tiktoken.Encoding] = {}


def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    key = hashlib.sha1(data + pattern.encode()).digest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pack_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, pad: int = 50256, shard_bytes: int = 8 << 20
) -> DataFrame:
    """One row per packed sequence of ``size`` ids.

    ``ids`` are ``size`` unsigned 32-bit little-endian integers, unused places
    hold ``pad``; ``positions`` likewise, counting from 0 in each segment (0 in
    unused places).  ``segments`` name each segment's document, piece number,
    first token within the document and length; ``cu_seqlens`` are the
    cumulative lengths from 0 on.

    * A null or empty text has no tokens and is in no sequence.
    * Null and repeated ids: every row's tokens are packed; rows of equal id and
      text are ordered arbitrarily among themselves, which changes nothing.
    * Other columns are not looked at.  Empty table: empty result.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    kind = docs.schema[id_col].dataType
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    source = source.withColumn("_shard", F.pmod(F.xxhash64("_id", F.octet_length("_text")), F.lit(shards))).where("_text <> ''")
    arrow_id = to_arrow_type(kind)
    piece_kind = pa.struct([(id_col, arrow_id), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])

    def run(key, table):
        release()
        enc = _encoding(vocabulary.value, pattern)
        table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        ids = table.column("_id").to_pylist()
        tokens = [np.array(enc.encode_ordinary(t.as_py()), np.uint32) for t in table.column("_text")]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pieces = -(-sizes // size)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * size
        length = np.minimum(sizes[doc] - start, size)
        where, used = best_fit_decreasing(length, size)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(used + 1))
        rows = []
        for s in range(used):
            mine = order[bounds[s] : bounds[s + 1]]
            row, place = np.full(size, pad, "<u4"), np.zeros(size, "<u4")
            ends = np.concatenate(([0], np.cumsum(length[mine])))
            for k, a in zip(mine.tolist(), ends.tolist()):
                n = int(length[k])
                row[a : a + n] = tokens[doc[k]][start[k] : start[k] + n]
                place[a : a + n] = np.arange(n)
            named = [{id_col: ids[doc[k]], "piece": int(piece[k]), "start": int(start[k]), "length": int(length[k])} for k in mine.tolist()]
            rows.append((key[0].as_py(), s, int(ends[-1]), named, ends.tolist(), row.tobytes(), place.tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(piece_kind), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["shard", "sequence", "n_tokens", "segments", "cu_seqlens", "ids", "positions"]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return source.groupBy("_shard").applyInArrow(run, PACKED.format(id=f"`{id_col}`", kind=kind.simpleString()))
