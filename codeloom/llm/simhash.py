"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distance.

A 64-bit fingerprint is cut into ``bits + kept`` blocks; two fingerprints that
differ in at most ``bits`` bits agree in at least ``kept`` whole blocks, so
they share one of the block-combination keys.  Equal fingerprints collapse to
one row first, so copies never meet in a bucket; a bucket of more than
``limit`` fingerprints is split into pairs of salted parts, which together
still compare every pair.  Of the links found in a part only a spanning forest
leaves the task.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.staging import stage
from codeloom.llm.words import release

SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text: words of the A-Z-lowered bytes, shingles with repeats, XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    cut = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long, a null text is empty."""

    def run(batches):
        for b in batches:
            texts = (t for a in range(0, b.num_rows, 500) for t in b.column(1).slice(a, 500).to_pylist())
            out = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, b.num_rows)
            release()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _blocks(bits: int, kept: int) -> list[int]:
    """Masks of every combination of ``kept`` of ``bits + kept`` blocks."""
    n = bits + kept
    bounds = [round(64 * k / n) for k in range(n + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in combinations(block, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` rows reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _linked(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and root fingerprint for the rows of equal ``group`` (sorted) that close pairs connect."""
    at, step, us, vs = np.arange(len(fp)), 1, [], []
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= bits]
        us.append(near)
        vs.append(near + step)
        step += 1
    if not us:
        return fp[:0], fp[:0]
    label = forest(len(fp), np.concatenate(us), np.concatenate(vs))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def close_pairs(prints: DataFrame, bits: int = 4, kept: int = 2, limit: int = 512) -> DataFrame:
    """(u, v): links whose components are those of all pairs within ``bits`` bits.

    ``prints`` has distinct fingerprints in ``fp``.
    """
    masks = _blocks(bits, kept)
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("tab", "key")
    )
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = (
        keyed.join(sizes, ["tab", "key"])
        .withColumn("s", F.ceil(F.col("n") / limit))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
        .select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    parts = parts.repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi", "fp")

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
            yield from out(change[:cut], cols[4][:cut])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from out(np.zeros(len(held[4]), bool), held[4])

    def out(change, fp):
        u, v = _linked(np.cumsum(change), fp, bits)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return parts.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, kept: int = 2, limit: int = 512
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits) and component_id.

    * Null or empty text: fingerprint zero, linked like any other.
    * Null ids: the row is returned; component_id is the smallest id that is
      not null in its group, or null if there is none.
    * Repeated rows and ids: one output row for each input row.
    * Empty table: empty result.  Other columns are not looked at.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = stage(components(close_pairs(reps.select("fp"), bits, kept, limit)), "roots")
    labelled = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
