"""Substring dedup: words covered by a long window that an earlier document has too.

Every window of ``window`` words is routed by its least 5-word hash, so equal
windows meet in one shard whatever documents they come from; windows in a row
with the same anchor travel as one segment.  A document's windows go only to
the shards that can hold them, and a segment leaves its document only if its
anchor occurs in another one.  Each shard builds a compressed FM-index over its
distinct segments and streams the segments through it: backward search gives
matching statistics, and where they reach the window the rows of the index tell
the smallest document that has the window.

An anchor that many chunks have may stand in text that many documents share,
with other words around it in each.  Windows around such an anchor are asked
for one by one, by a hash of all their words, and only those that another
document has travel on, routed by that hash: so no shard grows with the number
of documents that share a passage, but by one entry for each chunk.

Documents are grouped into chunks of bounded size by a hash of their id; what
a chunk asks and gets back are packed arrays, pre-aggregated, so that copies of
one passage cost one entry for each chunk.  Word hashes route; which windows
are equal is decided on words: in the index between chunks, and by comparing
segments of one hash word by word within a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codeloom.llm.fmindex import FMIndex
from codeloom.llm.words import chunks, hashes, pack_sorted, ragged, release, run_hashes, sequence_hashes, slices, spans, unpack_sorted

ANCHOR = 5
#: Columns added while the work goes on.
ID, TEXT, CHUNK = "substrings_id__", "substrings_text__", "substrings_chunk__"
LAST = 2**63 - 1
ASK = "bucket int, chunk long, keys binary, many binary"
ANSWER = "chunk long, bucket int, kind int, shared binary, hot binary"
SEND = "shard int, chunk long, keys binary, docs binary, texts binary"
FOUND = "chunk long, keys binary, early binary"


class Segments:
    """Segments of one chunk: arrays by segment, and the unique anchors."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.parts = []  # (bytes, word starts, word ends, first words, word hashes)
        found: dict[str, list] = {k: [] for k in ("start", "count", "anchor", "key", "row", "part")}
        for first, _, data, offsets in chunks(_column(table, TEXT)):
            starts, ends, word = spans(data, offsets)
            h = hashes(data, starts, ends)
            runs = np.maximum(np.diff(word) - window + 1, 0)
            own = ragged(word[:-1], runs)
            if len(own):
                g = sequence_hashes(h, ANCHOR)
                n = len(g) - (window - ANCHOR)
                least, place = g[:n].copy(), np.zeros(n, np.int64)
                for k in range(1, window - ANCHOR + 1):
                    less = g[k : k + n] < least
                    np.copyto(least, g[k : k + n], where=less)
                    place[less] = k
                text = np.repeat(np.arange(len(runs)), runs)
                at = own + place[own]
                cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
                size = np.diff(np.concatenate((cut, [len(own)])))
                for name, x in (
                    ("start", own[cut]), ("count", size), ("anchor", least[own[cut]]), ("key", run_hashes(h, own[cut], size + window - 1)),
                    ("row", first + text[cut]), ("part", np.full(len(cut), len(self.parts))),
                ):
                    found[name].append(x)
            self.parts.append((data, starts, ends, word, h))
        for name, x in found.items():
            kind = np.uint64 if name in ("anchor", "key") else np.int64
            setattr(self, name, np.concatenate(x) if x else np.empty(0, kind))
        self.doc = _ids(table.column(ID))[self.row]
        self.anchors, self.of = np.unique(self.anchor, return_inverse=True)
        self.hot = np.zeros(len(self.start), bool)

    def judge(self, answers: pa.Table, buckets: int) -> None:
        """Keep the segments whose anchor is shared, those of hot anchors as single windows."""
        shared, hot = (_bits(answers, 0, c, self.anchors, buckets)[self.of] for c in ("shared", "hot"))
        plain, single = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        n = self.count[single]
        start = ragged(self.start[single], n)
        part = np.repeat(self.part[single], n)
        key = np.empty(len(start), np.uint64)
        for p in np.unique(part).tolist():
            mine = part == p
            key[mine] = run_hashes(self.parts[p][4], start[mine], np.full(int(mine.sum()), self.window))
        self.start = np.concatenate((self.start[plain], start))
        self.count = np.concatenate((self.count[plain], np.ones(len(start), np.int64)))
        self.part = np.concatenate((self.part[plain], part))
        self.doc = np.concatenate((self.doc[plain], np.repeat(self.doc[single], n)))
        self.route = np.concatenate((self.anchor[plain], key))
        self.key = np.concatenate((self.key[plain], key))
        self.hot = np.concatenate((np.zeros(len(plain), bool), np.ones(len(start), bool)))

    def settle(self) -> None:
        """Compare the segments of one hash word by word; others that share it get keys of their own."""
        _, first, of, count = np.unique(self.key, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero((count[of] > 1) & (first[of] != np.arange(len(of))))
        lead = first[of[again]]
        if not len(again):
            return
        pieces = [_pieces(data, _covered(len(data), starts, ends), starts, ends) for data, starts, ends, _, _ in self.parts]
        numbers = pa.chunked_array(pieces).combine_chunks().dictionary_encode().indices.to_numpy()
        base = np.cumsum([0, *(len(x) for x in pieces)])
        del pieces
        place = base[self.part] + self.start
        same = self.count[again] == self.count[lead]
        pairs = np.flatnonzero(same)
        for a in range(0, len(pairs), 1 << 16):
            z = pairs[a : a + (1 << 16)]
            n = self.count[again[z]] + self.window - 1
            differ = numbers[ragged(place[again[z]], n)] != numbers[ragged(place[lead[z]], n)]
            same[z] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
        for k in np.unique(of[again[~same]]).tolist():  # a collision of 64 bits
            own = np.flatnonzero(of == k)
            texts = [self.text(x) for x in own.tolist()]
            number = {x: i for i, x in enumerate(sorted(set(texts)))}
            self.key[own] += np.array([number[x] for x in texts], np.uint64)

    def text(self, k: int) -> bytes:
        data, starts, ends, _, _ = self.parts[self.part[k]]
        a, b = self.start[k], self.start[k] + self.count[k] + self.window - 2
        return b" ".join(data[starts[a] : ends[b]].tobytes().split())


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the bytes of the ranges, which follow each other."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _bits(answers: pa.Table, kind: int, name: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of one kind, in the order of the sorted distinct keys asked for."""
    mine = answers.column("kind").to_pylist()
    got = {b: x for b, k, x in zip(answers.column("bucket").to_pylist(), mine, answers.column(name).to_pylist()) if k == kind}
    parts = [np.unpackbits(np.frombuffer(got[k], np.uint8), count=b - a) for k, a, b in slices(keys, buckets)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def _asked(keys: np.ndarray, docs: np.ndarray, buckets: int, chunk: int) -> pa.Table:
    """Rows that ask for the distinct keys, saying which of them several ids of this chunk have."""
    values, of = np.unique(keys, return_inverse=True)
    least, most = np.full(len(values), LAST), np.full(len(values), -LAST)
    np.minimum.at(least, of, docs)
    np.maximum.at(most, of, docs)
    many = least < most
    rows = [(k, chunk, pack_sorted(values[a:b]), np.packbits(many[a:b]).tobytes()) for k, a, b in slices(values, buckets)]
    return _table(rows, [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def _released(run):
    """The group function, giving its memory back when it is done."""

    def one(key, table):
        return two(key, table)

    def two(key, table, *more):
        try:
            return run(key, table, *more)
        finally:
            release()

    return (lambda key, table, other: two(key, table, other)) if run.__code__.co_argcount == 3 else one


def _table(rows: list[tuple], ddl_types: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in ddl_types]
    return pa.table({name: pa.array(list(c), kind) for c, (name, kind) in zip(cols, ddl_types)})


def _ask(buckets: int, window: int):
    def run(key, table):
        own = Segments(table, window)
        return _asked(own.anchor, own.doc, buckets, key[0].as_py())

    return run


def _ask_hot(buckets: int, window: int):
    def run(key, table, answers):
        own = Segments(table, window)
        own.judge(answers, buckets)
        return _asked(own.key[own.hot], own.doc[own.hot], buckets, key[0].as_py())

    return run


def _answer(kind: int, hot_chunks: int):
    def run(key, table):
        asked = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for x, a in zip(table.column("many").to_pylist(), asked)]
        _, of, count = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        shared = (count[of] > 1) | np.concatenate(many).astype(bool)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        shared, hot = ([np.packbits(x).tobytes() for x in np.split(bits, cuts)] for bits in (shared, count[of] >= hot_chunks))
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "kind": pa.array(np.full(len(asked), kind, np.int32)),
                "shared": pa.array(shared, pa.binary()),
                "hot": pa.array(hot, pa.binary()),
            }
        )

    return run


def _send(buckets: int, shards: int, window: int):
    kinds = [("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("texts", pa.binary())]

    def run(key, table, answers):
        own = Segments(table, window)
        own.judge(answers, buckets)
        own.settle()
        hot = np.unique(own.route[own.hot])
        keep = ~own.hot
        keep[own.hot] = _bits(answers, 1, "shared", hot, buckets)[np.searchsorted(hot, own.route[own.hot])]
        which = np.flatnonzero(keep)
        order = which[np.lexsort((own.doc[which], own.key[which], own.route[which]))]
        if not len(order):
            return _table([], kinds)
        new = np.concatenate(([True], (own.key[order][1:] != own.key[order][:-1]) | (own.route[order][1:] != own.route[order][:-1])))
        least = order[new]  # the first of equal segments has the smallest document
        most = order[np.concatenate((np.flatnonzero(new)[1:], [len(order)])) - 1]
        rows = []
        for k, a, b in slices(own.route[least], shards):
            docs = np.stack((own.doc[least[a:b]], own.doc[most[a:b]]))
            texts = b"\n".join(own.text(x) for x in least[a:b])
            rows.append((k, key[0].as_py(), own.key[least[a:b]].tobytes(), docs.tobytes(), texts))
        return _table(rows, kinds)

    return run


def _pieces(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as one Arrow array; ``inside`` marks the bytes of all ranges."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def _find(window: int):
    """One shard: index the distinct segments, stream them through it, answer the chunks.

    A chunk is told of each of its segments which windows a document smaller
    than all that hold the segment in that chunk has.
    """
    kinds = [("chunk", pa.int64()), ("keys", pa.binary()), ("early", pa.binary())]

    def run(key, table):
        docs = [np.frombuffer(d, np.int64).reshape(2, -1) for d in table.column("docs").to_pylist()]
        sizes = [d.shape[1] for d in docs]
        docs = np.concatenate(docs, axis=1)
        data = np.frombuffer(b"\n".join(table.column("texts").to_pylist()), np.uint8)
        line = np.flatnonzero(data == 10)
        coded = _pieces(data, data != 10, np.concatenate(([0], line + 1)), np.append(line, len(data))).dictionary_encode()
        of, distinct = coded.indices.to_numpy(), coded.dictionary
        del data, line, coded
        least, most = np.full(len(distinct), LAST), np.full(len(distinct), -LAST)
        np.minimum.at(least, of, docs[0])
        np.maximum.at(most, of, docs[1])
        (_, _, data, offsets), = chunks(distinct, 1 << 62)
        starts, ends, word = spans(data, offsets)
        lengths = np.diff(word)
        words = _pieces(data, data != 32, starts, ends).dictionary_encode()
        symbols = len(words.dictionary) + 1
        # each segment is followed by the separator 0
        first = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(lengths), np.int32)
        text[ragged(first, lengths)] = words.indices.to_numpy() + 1
        del words, distinct, data, starts, ends
        index = FMIndex(text, symbols, window)
        windows = lengths - window + 1
        matched, lo, hi = index.matches(text, ragged(first, windows) + window, window)
        low = np.repeat(least, windows)  # windows without a second place keep their own document
        full = np.flatnonzero(matched >= window)
        if len(full):
            starts, back = np.unique(lo[full], return_inverse=True)
            stops = np.zeros(len(starts), np.int64)
            stops[back] = hi[full]
            by_row = np.append(least[np.repeat(np.arange(len(lengths)), lengths + 1)[index.suffixes]], LAST)
            low[full] = np.minimum.reduceat(by_row, np.stack((starts, stops), axis=1).ravel())[::2][back]
        at = np.cumsum(windows) - windows
        rows, done = [], 0
        for chunk, keys, n in zip(table.column("chunk").to_pylist(), table.column("keys").to_pylist(), sizes):
            mine = slice(done, done + n)
            done += n
            o = of[mine]
            early = (low[ragged(at[o], windows[o])] < np.repeat(docs[0, mine], windows[o])).astype(np.uint64)
            bits = early << ragged(np.zeros(n, np.int64), windows[o]).astype(np.uint64)
            mask = np.add.reduceat(bits, np.cumsum(windows[o]) - windows[o])
            if (mask > 0).any():
                rows.append((chunk, np.frombuffer(keys, np.uint64)[mask > 0].tobytes(), mask[mask > 0].tobytes()))
        return _table(rows, kinds)

    return run


def _apply(buckets: int, window: int, schema_names: list[str]):
    def run(key, table, told):
        own = Segments(table, window)
        own.judge(told.filter(pc.is_valid(told.column("kind"))), buckets)
        own.settle()
        found = told.filter(pc.is_valid(told.column("keys")))
        _, of = np.unique(own.key, return_inverse=True)
        least = np.full(len(own.key), LAST)
        np.minimum.at(least, of, own.doc)
        # a window goes from every document but the first of this chunk that holds its segment ...
        every = np.uint64(2**64 - 1)
        mask = np.where(own.doc > least[of], every, np.uint64(0))
        if found.num_rows and len(own.key):  # ... and from that one if another chunk has a smaller document
            keys, early = (np.concatenate([np.frombuffer(x, np.uint64) for x in found.column(c).to_pylist()]) for c in ("keys", "early"))
            order = np.argsort(keys)
            at = order[np.minimum(np.searchsorted(keys[order], own.key), len(keys) - 1)]
            mask |= np.where(keys[at] == own.key, early[at], np.uint64(0))
        hit = np.flatnonzero(mask)
        inside = ragged(np.zeros(len(hit), np.int64), own.count[hit])
        go = (np.repeat(mask[hit], own.count[hit]) >> inside.astype(np.uint64) & np.uint64(1)).astype(bool)
        start = (np.repeat(own.start[hit], own.count[hit]) + inside)[go]
        part = np.repeat(own.part[hit], own.count[hit])[go]
        gone = {}  # part -> mask of removed words
        for p in np.unique(part).tolist():
            edge = np.zeros(len(own.parts[p][1]) + 1, np.int64)
            np.add.at(edge, start[part == p], 1)
            np.add.at(edge, start[part == p] + window, -1)
            gone[p] = np.cumsum(edge[:-1]) > 0
        kept, n_words, n_removed = [], [], []
        for p, (data, starts, ends, word, _) in enumerate(own.parts):
            mask = gone.get(p)
            for k in range(len(word) - 1):
                a, b = int(word[k]), int(word[k + 1])
                words = data[starts[a] : ends[b - 1]].tobytes().split() if b > a else []
                removed = int(mask[a:b].sum()) if mask is not None else 0
                if removed:
                    words = [words[x] for x in np.flatnonzero(~mask[a:b]).tolist()]
                kept.append(b" ".join(words))
                n_words.append(b - a)
                n_removed.append(removed)
        more = {"kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table({c: more.get(c) if c in more else table.column(c) for c in schema_names})

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    chunk_bytes: int = 4 << 20,
    shard_bytes: int = 2 << 20,
    hot_chunks: int = 48,
) -> DataFrame:
    """All columns of ``docs`` and ``kept``, ``n_words``, ``n_removed``; one row per input row.

    A word goes if a window of ``window`` words covers it whose words also
    start a window in a document with a smaller id; windows are judged on the
    input.  ``kept`` has the other words, joined by one blank.  An anchor that
    ``hot_chunks`` chunks ask for is hot.

    * Null text: no words.  Integer ids; a null id counts as larger than all
      others, and rows of equal id never shorten each other.
    * Columns named kept, n_words or n_removed are replaced.  Empty table:
      empty result.
    """
    if not ANCHOR <= window < ANCHOR + 64:
        raise ValueError(f"a window has {ANCHOR} to {ANCHOR + 63} words")
    docs = docs.drop(*[c for c in ("kept", "n_words", "n_removed") if c in docs.columns])
    text = F.col(text_col).cast("binary")
    total, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    n_chunks = max(1, -(-total // chunk_bytes), -(-n_rows // max(1, chunk_bytes // 16)))  # tiny texts count as rows
    shards = max(1, -(-total // shard_bytes))
    buckets = max(1, -(-total // (8 * shard_bytes)))
    names = docs.columns
    source = docs.withColumns(
        {
            ID: F.col(id_col).cast("long"),
            TEXT: text,
            CHUNK: F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.octet_length(text)), F.lit(n_chunks)).cast("long"),
        }
    ).select(*[f"`{c}`" for c in names if c != text_col], ID, TEXT, CHUNK)
    by_chunk = source.groupBy(CHUNK)
    asked = by_chunk.applyInArrow(_released(_ask(buckets, window)), ASK)
    answers = asked.groupBy("bucket").applyInArrow(_released(_answer(0, hot_chunks)), ANSWER)
    asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_released(_ask_hot(buckets, window)), ASK)
    both = answers.union(asked.groupBy("bucket").applyInArrow(_released(_answer(1, hot_chunks)), ANSWER))
    sent = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(_released(_send(buckets, shards, window)), SEND)
    found = sent.groupBy("shard").applyInArrow(_released(_find(window)), FOUND)
    fields = [f for f in source.schema.fields if f.name not in (ID, CHUNK)]
    schema = StructType([*fields, StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    told = answers.unionByName(found, allowMissingColumns=True)
    out = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_released(_apply(buckets, window, [f.name for f in schema.fields])), schema)
    text = F.col(TEXT).cast("string").alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in names], "kept", "n_words", "n_removed")
