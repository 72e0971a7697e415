"""Words of UTF-8 texts as NumPy arrays, for Arrow batches inside tasks.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D.  Hashes of
words and of word sequences are 64-bit; they route and pre-filter, and each
operator says where the words themselves are compared afterwards.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array, limit: int = 1 << 20):
    """Cut a string or binary column into row ranges of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); a null counts as empty and a
    row beyond the limit stands alone.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more at the end)."""
    word = _IS_WORD[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """64-bit hash of each byte range (ranges in order, without overlap); long data go in parts of ``limit`` bytes."""
    if len(data) > limit and len(starts) > 1:
        half = len(starts) // 2
        cut = int(starts[half])
        return np.concatenate((hashes(data[:cut], starts[:half], ends[:half]), hashes(data[cut:], starts[half:] - cut, ends[half:] - cut)))
    power, inverse = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive hashes (runs cross text bounds: the caller masks them)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _BASE + h[k : len(h) - n + 1 + k])
    return out


def run_hashes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the runs of ``lengths`` hashes from ``starts`` on; runs may overlap."""
    power, inverse = _grown(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones and so on: small numbers then compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as packed differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


_libc = ctypes.CDLL(None)


def release() -> None:
    """Hand freed memory back to the system: a Python worker outlives its task, and what it keeps others lack."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key; it never falls as the key rises."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def slices(sorted_keys: np.ndarray, buckets: int):
    """(bucket, first, end) of each bucket that holds some of the sorted keys."""
    own = bucket_of(sorted_keys, buckets)
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)]):
        yield int(own[a]), a, b


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of ``lengths`` entries for each range, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
