"""Byte-level BPE: boundaries by an associative scan over codepoint classes, then cached pair merging.

The pre-tokenisation pattern of the public byte-level vocabularies is run as a
deterministic automaton. Every codepoint, with one or two codepoints of look-ahead,
is a symbol; every symbol is a function from states to states; functions compose
associatively, and only a few dozen compositions exist. So blocks of the text are
scanned side by side with table look-ups, their totals are combined, and the state
before each codepoint tells whether a piece starts there. No regular expression runs.
"""

from __future__ import annotations

import base64
import functools
import json
import sys
import unicodedata
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd

from .common import offsets, ragged
from .slices import factorize

# The codepoints with the property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the pattern, without the apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Letters and numbers that Unicode 16 adds to the tables of Unicode 15.1, first and last of each range.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

NEVER = 1 << 40
END = 0x110000  # stands between documents
LETTER, NUMBER, OTHER, SPACE, STOP = range(5)
# Symbols: a letter, a number, anything else, an apostrophe that may start a contraction of 1 or 2
# letters, white space before white space or the end, white space or U+0020 before anything else, the end.
SYM_L, SYM_N, SYM_O, SYM_Q1, SYM_Q2, SYM_W, SYM_B, SYM_A, SYM_X = range(9)
# States: what the piece so far still takes in.
NOTHING, LETTERS, NUMBERS, OTHERS, BLANKS, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the symbol."""
    if symbol == SYM_L:
        if state in (ONE_MORE, TWO_MORE):
            return state - 1 if state == TWO_MORE else NOTHING, False
        return LETTERS, state not in (LETTERS, AFTER_SPACE)
    if symbol == SYM_N:
        return NUMBERS, state not in (NUMBERS, AFTER_SPACE)
    if symbol in (SYM_O, SYM_Q1, SYM_Q2):
        if state in (OTHERS, AFTER_SPACE):
            return OTHERS, False
        return {SYM_O: OTHERS, SYM_Q1: ONE_MORE, SYM_Q2: TWO_MORE}[symbol], True
    if symbol == SYM_W:
        return BLANKS, state != BLANKS
    return {SYM_B: NOTHING, SYM_A: AFTER_SPACE, SYM_X: NOTHING}[symbol], True


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions, their composition table, each function's image of NOTHING, starts by (state, symbol)."""
    generators = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {tuple(range(8)): 0}
    todo = list(known)
    for f in todo:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([known[g] for g in generators], np.uint16), compose, np.array([f[NOTHING] for f in functions], np.uint8), starts


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all functions before each place (identity first): blocks side by side, then their totals."""
    n, size = len(functions), len(compose)
    flat = compose.ravel()
    if n <= 64:
        out, x = np.empty(n, np.uint16), 0
        for k, f in enumerate(functions.tolist()):
            out[k] = x
            x = int(compose[x, f])
        return out
    width = max(8, int(np.sqrt(n)) // 2)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.int64)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    scaled = flat.astype(np.int64) * size  # a function times the table's width: its row
    x = np.zeros(rows, np.int64)
    for k in range(width):
        now = columns[k] + x
        columns[k] = x
        scaled.take(now, out=x)
    before = _scan(x // size, compose).astype(np.int64) * size
    within = columns // size
    return flat[within + before[None, :]].T.ravel()[:n]


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.full(END + 1, OTHER, np.uint8)
    kinds[:END] = np.frombuffer(bytes({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END)), np.uint8)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[WHITE_SPACE] = SPACE
    kinds[END] = STOP
    return kinds


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern starts at each codepoint; END separates documents and starts one of its own."""
    kinds = _classes()[points]
    follow = np.append(kinds[1:], np.uint8(STOP))
    symbols = np.array([SYM_L, SYM_N, SYM_O, SYM_W, SYM_X], np.uint8)[kinds]
    blank = np.flatnonzero((kinds == SPACE) & (follow < SPACE))
    symbols[blank] = np.where(points[blank] == 0x20, SYM_A, SYM_B)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        tail = np.append(points, [END, END])
        one, two = tail[quotes + 1], tail[quotes + 2]
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & (two == ord(c[1]) if len(c) == 2 else True)
            symbols[quotes[hit]] = SYM_Q1 if len(c) == 1 else SYM_Q2
    ids, compose, state, starts = _monoid()
    return starts.ravel()[state[_scan(ids[symbols], compose)].astype(np.intp) * 9 + symbols]


def pieces(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, byte start and length of each piece, and the number of the first piece of each text (and the end)."""
    joined = "".join(texts)
    data = joined.encode()
    spread = np.empty(len(joined) + len(texts), np.uint32)
    ends = offsets(np.fromiter(map(len, texts), np.int64, len(texts)))[1:] + np.arange(len(texts))
    real = np.ones(len(spread), bool)
    real[ends] = False
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    spread[real], spread[ends] = points, END
    first = piece_starts(spread)
    pieces_before = offsets(first & real)
    if len(data) == len(joined):
        starts = np.flatnonzero(first[real])
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        starts = offsets(width)[:-1][first[real]]
    return data, starts, np.diff(starts, append=len(data)), np.append(0, pieces_before[ends]) if len(texts) else np.zeros(1, np.int64)


class Encoder:
    """Encodes by merge ranks; results of pieces are kept, up to ``keep`` of them.

    ``ranks`` maps a token's bytes to its id. ``merges`` gives the order of pairs; without it, the
    merged token's id is the order, as in rank files. ``special`` maps strings to ids that texts
    may hold and that stand for themselves.
    """

    def __init__(self, ranks: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None = None, special: dict[str, int] | None = None, keep: int = 250_000):
        self.ranks, self.merges, self.special, self.keep = ranks, merges, special or {}, keep
        self.known: dict[bytes, bytes] = {}  # ids as little-endian words of 4 bytes
        self.code = {t: k.to_bytes(4, "little") for t, k in ranks.items()}
        #: (left, right): order of the merge; without given merges, every cut of a token into two tokens.
        self.pair = merges if merges is not None else {(t[:k], t[k:]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, k in ranks.items():
            self.token[k] = t
        for t, k in self.special.items():
            self.token[k] = t.encode()
        self.decimal = [str(k) for k in range(size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        ways = sorted(self.pair.items(), key=lambda x: x[1])
        self.pairs = pd.Index(np.array([ranks[a] * size + ranks[b] for (a, b), _ in ways], np.int64))
        self.orders = np.array([*(r for _, r in ways), NEVER], np.int64)  # place -1: no such pair
        self.made = np.zeros(int(self.orders[-2]) + 1, np.int64)
        self.made[self.orders[:-1]] = [ranks[a + b] for (a, b), _ in ways]

    def merge(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each piece: its pair of least rank merges first, the leftmost of equals.

        All pieces take their next merge together; a piece leaves when none is left.
        """
        out = [b""] * len(distinct)
        todo: list[int] = []
        for k, p in enumerate(distinct):
            if (whole := self.code.get(p)) is not None and (self.merges is None or len(p) == 1):
                out[k] = whole
            elif len(p) > 64:
                out[k] = self._merge_long([p[j : j + 1] for j in range(len(p))])
            else:
                todo.append(k)
        if not todo:
            return out
        sizes = np.fromiter((len(distinct[k]) for k in todo), np.int64, len(todo))
        symbols = self.byte_id[np.frombuffer(b"".join(distinct[k] for k in todo), np.uint8)]
        piece = np.repeat(np.array(todo), sizes)
        order = np.full(len(symbols), NEVER, np.int64)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        order[inner] = self._orders(symbols[inner], symbols[inner + 1])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            lengths = np.diff(heads, append=len(piece))
            least = np.minimum.reduceat(order, heads)
            if (done := least == NEVER).any():
                gone = np.repeat(done, lengths)
                data, ends = symbols[gone].astype("<u4").tobytes(), np.cumsum(lengths[done]) * 4
                for k, e, n in zip(piece[heads[done]].tolist(), ends.tolist(), (lengths[done] * 4).tolist(), strict=True):
                    out[k] = data[e - n : e]
                symbols, piece, order = symbols[~gone], piece[~gone], order[~gone]
                lengths, least = lengths[~done], least[~done]
                if not len(symbols):
                    break
            hits = np.flatnonzero(order == np.repeat(least, lengths))
            hits = hits[np.append(True, piece[hits[1:]] != piece[hits[:-1]])]
            symbols[hits] = self.made[order[hits]]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            at = hits - np.arange(len(hits))  # one part of each earlier piece is gone
            symbols, piece, order = symbols[stay], piece[stay], order[stay]
            for left in (at - 1, at):
                left = left[left >= 0]
                pair = left[left + 1 < len(symbols)]
                pair = pair[piece[pair] == piece[pair + 1]]
                order[pair] = self._orders(symbols[pair], symbols[pair + 1])
            last = at[(at + 1 >= len(symbols)) | (piece[at] != piece[np.minimum(at + 1, len(symbols) - 1)])]
            order[last] = NEVER
        return out

    def _orders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The order of the merge of each pair, or NEVER."""
        return self.orders[self.pairs.get_indexer(left.astype(np.int64) * len(self.token) + right)]

    def _rank(self, a: bytes, b: bytes) -> int | None:
        return self.pair.get((a, b))

    def _merge_long(self, parts: list[bytes]) -> bytes:
        """The same over a heap and linked parts, for pieces where rescanning would be quadratic."""
        import heapq

        n = len(parts)
        after, prior = [*range(1, n), -1], [-1, *range(n - 1)]
        live: list[bytes | None] = list(parts)
        heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := self._rank(parts[k], parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, both = heapq.heappop(heap)
            j = after[k]
            if live[k] is None or j < 0 or live[k] + live[j] != both or self._rank(live[k], live[j]) != r:
                continue
            live[k], live[j] = both, None
            after[k] = after[j]
            if after[j] >= 0:
                prior[after[j]] = k
            for x, y in ((prior[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (s := self._rank(live[x], live[y])) is not None:
                    heapq.heappush(heap, (s, x, live[x] + live[y]))
        return b"".join(self.code[p] for p in live if p is not None)

    def lookup(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each distinct piece."""
        if len(self.known) > self.keep:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        self.known.update(zip(new, self.merge(new), strict=True))
        return [self.known[p] for p in distinct]

    def encode_pieces(self, texts: Sequence[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Code of each piece, ids of each code, first piece of each text (and the end)."""
        if any(s in t for s in self.special for t in texts):
            return self._with_special(texts)
        data, starts, lengths, first = pieces(texts)
        codes, distinct = factorize(data, starts, lengths)
        return codes, self.lookup(distinct), first

    def _with_special(self, texts: Sequence[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        parts: list[str] = []
        text_of: list[int] = []
        for k, t in enumerate(texts):
            todo = [t]
            for s in self.special:
                todo = [y for x in todo for y in ([x] if x in self.special else [z for w in x.split(s) for z in (w, s)][:-1])]
            parts += todo
            text_of += [k] * len(todo)
        plain = ["" if p in self.special else p for p in parts]
        data, starts, lengths, first = pieces(plain)
        codes, distinct = factorize(data, starts, lengths)
        ids = self.lookup(distinct)
        own = {s: len(ids) + k for k, s in enumerate(self.special)}
        runs = [np.array([own[p]]) if p in own else codes[a:b] for p, a, b in zip(parts, first[:-1], first[1:], strict=True)]
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, text_of, [len(r) for r in runs])
        return np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64), [*ids, *(k.to_bytes(4, "little") for k in self.special.values())], offsets(counts)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place of each text's first (and the end)."""
        codes, ids, first = self.encode_pieces(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = sizes[codes]
        return ragged(flat, offsets(sizes)[:-1][codes], lengths), offsets(lengths)[first]

    def token_spans(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id in the decoded bytes, and the end."""
        return offsets(np.fromiter((len(self.token[k]) for k in ids.tolist()), np.int64, len(ids)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.cache
def from_rank_file(path: str) -> Encoder:
    """An encoder by a file of base64 tokens and ranks."""
    lines = Path(path).read_bytes().split(b"\n")
    return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in JSON vocabularies: printable bytes themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def from_json_file(path: str) -> Encoder:
    """An encoder by a byte-level vocabulary in JSON, with its merges and its special tokens."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    merges = {(sys.intern(a) and raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
    return Encoder(ranks, merges, special)
