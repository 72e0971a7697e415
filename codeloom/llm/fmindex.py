"""A compressed FM-index over a sequence of word numbers: wavelet matrix with packed bits.

The rows are the suffixes ordered by their first ``depth`` symbols, which is
all that backward search for patterns of up to ``depth`` symbols needs.
Searches run on whole arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """Packed bits with rank: the number of ones before a place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.before = np.concatenate(([0], counts[:-1])).astype(np.int32)
        self.zeros = len(bits) - int(counts[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Index of ``text`` (numbers from 0 to ``symbols`` - 1); its last symbol must be in no pattern."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, length = text.astype(np.uint32), 1
        while length < depth:
            key = rank.astype(np.uint64) << np.uint64(32)
            key[: n - length] |= rank[length:] + np.uint64(1)
            order = np.argsort(key)
            key = key[order]
            new = np.zeros(n, bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            del key
            rank[order] = np.cumsum(new, dtype=np.uint32)
            length *= 2
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        column = text[self.suffixes - 1]  # the symbol before each suffix
        self.levels: list[tuple[int, _Bits]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            one = (column >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(one)))
            column = np.concatenate((column[~one], column[one]))
        del column
        every = np.arange(symbols)
        self.start = self._sink(every, np.zeros(symbols, np.int64))

    def _sink(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def begin(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol."""
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows of symbol + pattern, from the pattern's rows."""
        shift = self.first[symbol] - self.start[symbol]
        return self._sink(symbol, lo) + shift, self._sink(symbol, hi) + shift

    def matches(self, text: np.ndarray, ends: np.ndarray, depth: int, step: int = 1 << 17):
        """Matching statistics of the patterns that end before ``ends`` in ``text``.

        Each pattern grows to the left for as long as two suffixes match it, to
        ``depth`` symbols at most.  Returns the matched length and the rows of
        the patterns that reached ``depth`` (empty rows for the others).
        """
        length = np.zeros(len(ends), np.int64)
        rows = np.zeros((2, len(ends)), np.int64)
        for a in range(0, len(ends), step):
            which = np.arange(a, min(a + step, len(ends)))
            lo, hi = self.begin(text[ends[which] - 1])
            for k in range(1, depth + 1):
                more = hi - lo > 1
                which, lo, hi = which[more], lo[more], hi[more]
                length[which] = k
                if k == depth or not len(which):
                    break
                lo, hi = self.extend(text[ends[which] - 1 - k], lo, hi)
            rows[0, which], rows[1, which] = lo, hi
        return length, rows[0], rows[1]
