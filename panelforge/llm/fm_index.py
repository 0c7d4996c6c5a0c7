"""A compressed FM-index over word codes: a wavelet matrix of the transformed text, backward search for many patterns at once.

What stays after construction: a bit for each symbol and level, a count of 32 bits for every 64 of them, and for each
suffix its document, in the least integers that hold their number. Documents stand in place of sampled suffix
positions, since matches are reported by document; the text, the ranks and the suffix array are given up.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense order-preserving ranks."""
    order = np.argsort(keys, kind="stable")
    now = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(0, now[1:] != now[:-1]))
    return out


def bounded_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` symbols, by doubling."""
    rank, done = _ranks(text), 1
    while done < depth:
        step = min(done, depth - done)
        tail = np.zeros(len(rank), np.int64)
        tail[: len(rank) - step] = rank[step:] + 1
        rank = _ranks(rank * (int(tail.max()) + 1) + tail)
        done += step
    return rank


class WaveletMatrix:
    """Bits of the symbols by level, packed, with the number of ones before each word of 64 bits."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.size = n
        self.depth = max(1, int(symbols.max()).bit_length()) if n else 1
        self.words, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> np.uint32(level) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(n // 64 * 8 + 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view("<u8")
            self.words.append(words)
            self.ones.append((np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype(np.uint32))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.now = now

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        word = at >> 6
        below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[level][word].astype(np.int64) + np.bitwise_count(below)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.words, *self.ones))


class FMIndex:
    """Counts patterns of at most ``depth`` symbols and finds the least document of those that have one.

    Suffixes are sorted by their first ``depth`` symbols only; the steps of a backward search for such a
    pattern look no further. Symbol 0 separates texts and is in no pattern. documents: of each place of the text.
    """

    def __init__(self, text: np.ndarray, depth: int, documents: np.ndarray | None = None):
        if len(text) >= 1 << 32:
            raise ValueError("an index holds fewer than 2**32 symbols")
        self.depth = depth
        suffixes = np.argsort(bounded_ranks(text, depth), kind="stable")
        bwt = text[suffixes - 1]  # place -1 is the last symbol, a separator
        self.counts = np.append(0, np.cumsum(np.bincount(text)))
        self.matrix = WaveletMatrix(bwt)
        last = self.matrix.now  # the symbols after the last level, equal ones together
        heads = np.flatnonzero(np.append(True, last[1:] != last[:-1])) if len(last) else np.zeros(0, np.int64)
        self.base = np.zeros(len(self.counts) - 1, np.int64)
        self.base[last[heads]] = heads
        del self.matrix.now
        self.names, own = np.unique(np.arange(len(text)) if documents is None else documents, return_inverse=True)
        # One more at the end, larger than all: intervals may end there.
        self.documents = np.append(own[suffixes], len(self.names)).astype(np.min_scalar_type(len(self.names)))

    @property
    def nbytes(self) -> int:
        return self.matrix.nbytes + self.documents.nbytes + self.names.nbytes + self.counts.nbytes + self.base.nbytes

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least document of each interval of suffixes, none of which is empty."""
        if not len(low):
            return np.zeros(0, self.names.dtype)
        return self.names[np.minimum.reduceat(self.documents, np.stack([low, high], axis=1).ravel())[::2]]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with one more symbol in front."""
        m = self.matrix
        ends = np.concatenate([low, high])
        for level in range(m.depth):
            ones = m.rank(level, ends)
            bit = (symbol >> (m.depth - 1 - level) & 1).astype(bool)
            ends = np.where(np.concatenate([bit, bit]), m.zeros[level] + ones, ends - ones)
        shift = self.counts[symbol] - self.base[symbol]
        return ends[: len(low)] + shift, ends[len(low) :] + shift

    def matching(self, text: np.ndarray, starts: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the windows text[s : s + depth], searched from their ends.

        Returns how many symbols were matched while at least ``least`` suffixes were left, and the suffix
        interval then. A window with all of its ``depth`` symbols matched occurs that often.
        """
        end = starts + self.depth - 1
        low, high = self.counts[text[end]].copy(), self.counts[text[end] + 1].copy()
        matched = np.ones(len(starts), np.int64)
        at = np.flatnonzero(high - low >= least)
        for back in range(1, self.depth):
            a, b = self.step(text[end[at] - back], low[at], high[at])
            stay = b - a >= least
            at = at[stay]
            low[at], high[at] = a[stay], b[stay]
            matched[at] += 1
        return matched, low, high
