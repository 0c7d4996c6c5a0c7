"""Exact token counts of every prefix by dynamic programming, for a sentencepiece BPE model.

The encoding of a prefix ends in one token; without it, it is the encoding of a shorter
prefix. So going through a text, the last token of each prefix is the one token that ends there and that
may stand after the last token of what is left, and its count is one more. Two tokens may stand side
by side if encoding their joined text gives just the two. Truncation and budgets are then look-ups.

No token crosses two characters that no piece holds side by side, so texts fall into units
that are counted once each, wherever they occur.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_columns import decoded
from .common import chunks, offsets, prepare, ragged, spread, texts_of
from .slices import factorize

BLANK = "▁"  # stands for U+0020 in pieces


class PrefixCounter:
    """Counts by the pieces of a model; keeps the counts of up to ``keep`` units."""

    def __init__(self, model_file: str, keep: int = 700_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        usable = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.score = {model.id_to_piece(k): -model.get_score(k) for k in usable}
        self.ident = {p: k for k, p in enumerate(self.score)}
        self.piece = list(self.ident)
        self.longest = max(map(len, self.piece))
        self.keep = keep
        self.known: dict[bytes, bytes] = {}
        self.beside: dict[int, bool] = {}
        # Characters of longer pieces get numbers from 1 on; adjacent[a, b]: some piece holds a just before b.
        joined = sorted({c for p in self.piece if len(p) > 1 for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        self.adjacent = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for p in self.piece:
            n = self.number[[ord(c) for c in p]]
            self.adjacent[n[:-1], n[1:]] = len(p) > 1
        self.adjacent[0] = self.adjacent[:, 0] = False

    def encode(self, unit: str) -> list[str]:
        """The pieces of a short string: the pair of best score merges first, the leftmost of equals."""
        parts = list(unit)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` may stand after ``left``; -1 is the start of a unit."""
        key = (left + 1) * len(self.piece) + right
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            own = ([self.piece[left]] if left >= 0 else []) + [self.piece[right]]
            found = self.beside[key] = self.encode("".join(own)) == own
        return found

    def unit_counts(self, unit: str) -> bytes:
        """Little-endian 32-bit counts of the unit's prefixes of 1, 2, ... characters."""
        if len(unit) == 1:
            return array("I", [1 if unit in self.ident else len(unit.encode())]).tobytes()
        ident, may, longest = self.ident, self._may_follow, self.longest
        counts, last = array("I", [0]), [-1]
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                token = ident.get(unit[start:end])
                if token is not None and may(last[start], token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends the prefix {unit[:end]!r}")
        return counts[1:].tobytes()

    def units(self, texts: Sequence[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Code of each unit, prefix counts of each code, first unit of each text (and the end), characters of each unit."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(marked)
        data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = offsets(np.fromiter(map(len, marked), np.int64, len(marked)))
        number = self.number[points]
        first = np.ones(len(points), bool)
        first[1:] = ~self.adjacent[number[:-1], number[1:]]
        first[ends[:-1][ends[:-1] < len(points)]] = True
        heads = np.flatnonzero(first)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        starts = offsets(width)[heads]
        codes, distinct = factorize(data, starts, np.diff(starts, append=len(data)))
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for u in distinct:
            if u not in known:
                known[u] = self.unit_counts(u.decode())
        return codes, [known[u] for u in distinct], np.append(0, np.cumsum(first))[ends], np.diff(heads, append=len(points))

    def totals(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of each whole text."""
        codes, counts, first, _ = self.units(texts)
        return self._totals(codes, counts, first)

    @staticmethod
    def _totals(codes: np.ndarray, counts: list[bytes], first: np.ndarray) -> np.ndarray:
        whole = np.frombuffer(b"".join(c[-4:] for c in counts), "<u4").astype(np.int64)
        return np.diff(offsets(whole[codes])[first])

    def prefixes(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each text, the tokens of its prefixes of 0, 1, 2, ... characters."""
        codes, counts, first, _ = self.units(texts)
        sizes = np.fromiter(map(len, counts), np.int64, len(counts)) // 4
        flat = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        whole = flat[np.cumsum(sizes) - 1] if len(sizes) else sizes
        out = []
        for a, b, t in zip(first[:-1], first[1:], texts, strict=True):
            own = codes[a:b]
            done = offsets(whole[own])[:-1]
            each = ragged(flat, offsets(sizes)[:-1][own], sizes[own]) + np.repeat(done, sizes[own])
            each[:1] = 0  # the blank put before the text is no prefix of its own
            out.append(each if t else np.zeros(1, np.int64))
        return out


def longest_within(prefix: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix <= budget)[-1])


@functools.cache
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def store_prefixes(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts array<int>): element k (from 0) is the token count of the first k characters.

    A null or empty text has the one element 0. Any budget is answered by it, e.g. with
    ``filter(sequence(0, size(counts) - 1), k -> counts[k] <= budget)``, without encoding again.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = counter(model_file)
        for ids, texts in chunks(batches):
            found = count.prefixes(decoded(texts))
            lists = pa.ListArray.from_arrays(pa.array(offsets(np.array([len(f) for f in found])), pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "counts"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, counts array<int>")


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within) of every whole text.

    ``chars_within``: characters of its longest prefix of at most ``limit`` tokens. A null or empty text has
    no tokens. Equal texts give equal values; bytes that are no UTF-8 count as U+FFFD. A very long text is counted whole; repeated rows
    repeat theirs; an empty table gives no rows; other columns are pruned.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = counter(model_file)
        for ids, texts in chunks(batches):
            own = decoded(texts)
            totals = count.totals(own)
            within = [len(t) for t in own]
            for k in np.flatnonzero(totals > limit).tolist():
                within[k] = longest_within(count.prefixes(own[k : k + 1])[0], limit)
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(totals > limit), pa.array(within, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")
