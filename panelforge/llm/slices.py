"""Exact codes for byte slices: equal slices get equal small integers, without hashing collisions."""

from __future__ import annotations

import numpy as np
import pandas as pd

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def factorize(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the slices and the distinct slices in the codes' order.

    Slices of up to 8 bytes are compared as one machine word, up to 16 as two, longer ones as bytes.
    Words carry no length, so data that hold a zero byte go the way of the longer ones.
    """
    codes = np.empty(len(starts), np.int64)
    found: list[bytes] = []
    buffer = np.frombuffer(data + bytes(16), np.uint8)
    word = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    plain = b"\0" not in data
    short, middle = (lengths <= 8) & plain, (lengths > 8) & (lengths <= 16) & plain

    def note(at: np.ndarray, code: np.ndarray, count: int) -> None:
        codes[at] = code + len(found)
        first = np.empty(count, np.int64)
        first[code[::-1]] = at[::-1]
        found.extend(data[s:e] for s, e in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist(), strict=True))

    if len(at := np.flatnonzero(short)):
        code, values = pd.factorize(word[starts[at]] & _MASKS[lengths[at]])
        note(at, code, len(values))
    if len(at := np.flatnonzero(middle)):
        low, seen = pd.factorize(word[starts[at]])
        high, _ = pd.factorize(word[starts[at] + 8] & _MASKS[lengths[at] - 8])
        code, values = pd.factorize(high * np.int64(len(seen)) + low)
        note(at, code, len(values))
    if len(at := np.flatnonzero(~(short | middle))):
        own = [data[s:e] for s, e in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)]
        index = {x: k for k, x in enumerate(dict.fromkeys(own))}
        note(at, np.fromiter(map(index.__getitem__, own), np.int64, len(own)), len(index))
    return codes, found
