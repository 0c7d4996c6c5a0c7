"""Repeated word windows across documents, by compressed FM-indexes of content-defined shards.

Every window of ``span`` words has a minimizer, the least hash of its runs of ``seed`` words. Runs of
windows with one minimizer are cut out as segments (about 16 words) and go to the shard that their
minimizer names, so all occurrences of a window meet in one shard however many there are, and each
shard indexes its own segments only. The documents' segments are then streamed, block by block, through a backward
search over the wavelet matrix, which computes their matching statistics; intervals that match over the whole span are reported
with the smallest document that has them. Texts travel as compressed chunks; a chunk sends each
distinct segment once, so copies and passages that many documents share don't crowd a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, prepare, ragged, spread, stored_bytes, texts_of, tidy, trim
from .fm_index import FMIndex
from .slices import factorize

CHUNK = 4 << 20
#: Bytes of the stored table for each shard, at most, and windows searched at a time.
SHARD, BLOCK = 32 << 20, 1 << 17
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_NO_DOC = np.iinfo(np.int64).max


def pack(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def unpack(blob: bytes, *kinds: type | None) -> list:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = offsets(np.frombuffer(data, np.int64, len(kinds))) + 8 * len(kinds)
    return [data[a:b] if k is None else np.frombuffer(data[a:b], k) for a, b, k in zip(at[:-1], at[1:], kinds, strict=True)]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word: longest runs without 0x20 and 0x09 to 0x0D."""
    blank = np.ones(len(data) + 2, np.int8)
    blank[1:-1] = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, 8 bytes at a time."""
    buffer = np.frombuffer(data + bytes(8), np.uint8)
    word = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    h = lengths.astype(np.uint64)
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        rest = lengths[todo] - at
        h[todo] = _mix(h[todo] ^ (word[starts[todo] + at] & _MASKS[np.minimum(rest, 8)]))
        todo, at = todo[rest > 8], at + 8
    return h


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def run_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of runs of symbols, by prefix sums."""
    power = np.full(len(symbols) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(symbols) + 1, _inverse(base), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.append(np.uint64(0), np.cumsum(symbols * power[:-1]))
    return _mix((sums[starts + lengths] - sums[starts]) * back[starts] + lengths.astype(np.uint64))


_BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def distinct_runs(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each run of symbols (equal runs, equal codes; two hashes decide) and the first run of each code."""
    one, two = (run_hashes(symbols, starts, lengths, b) for b in _BASES)
    codes, seen = pd.factorize(one)
    first = _first_of(codes, len(seen))
    if (two != two[first][codes]).any():
        codes, seen = pd.factorize(codes * np.int64(len(two) + 1) + pd.factorize(two)[0])
        first = _first_of(codes, len(seen))
    return codes, first


def _first_of(codes: np.ndarray, count: int) -> np.ndarray:
    first = np.empty(count, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


@dataclass
class Chunk:
    """Documents' words, and the distinct segments of their windows. A function of the documents alone."""

    ids: np.ndarray
    text: bytes  # each word followed by one blank
    at: np.ndarray  # byte place of each word in text, and the end
    first: np.ndarray  # first word of each document, and the end
    code: np.ndarray  # of each occurrence of a segment
    start: np.ndarray  # its first word
    doc: np.ndarray  # its document's place
    windows: np.ndarray  # by code: number of windows
    origin: np.ndarray  # by code: first word of one occurrence
    minimizer: np.ndarray  # by code


def cut(ids: np.ndarray, texts: list[bytes], span: int, seed: int) -> Chunk:
    data = b" ".join(texts)
    starts, lengths = word_spans(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.append(offsets(sizes)[:-1] + np.arange(len(texts)), len(data)))
    text = ragged(np.frombuffer(data + b" ", np.uint8), starts, lengths + 1)
    at = offsets(lengths + 1)
    text[at[1:] - 1] = 0x20
    text = text.tobytes()
    n, windows = len(starts), max(0, len(starts) - span + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = doc[:windows] == doc[span - 1 :][:windows]
    if not whole.any():
        none = np.zeros(0, np.int64)
        return Chunk(ids, text, at, first, none, none, none, none, none, none.astype(np.uint64))
    h = word_hashes(text, at[:-1], lengths)
    runs = np.zeros(n - seed + 1, np.uint64)
    for k in range(seed):
        runs = runs * np.uint64(_BASES[0]) + h[k : n - seed + 1 + k]
    runs = _mix(runs)
    least, where = runs[:windows].copy(), np.arange(windows)
    for k in range(1, span - seed + 1):
        other = runs[k : k + windows]
        less = np.flatnonzero(other < least)
        least[less] = other[less]
        where[less] = less + k
    head = whole.copy()
    head[1:] &= ~whole[:-1] | (where[1:] != where[:-1])
    start = np.flatnonzero(head)
    count = np.bincount((np.cumsum(head) - 1)[whole], minlength=len(start))
    code, origin = distinct_runs(h, start, count + span - 1)
    return Chunk(ids, text, at, first, code, start, doc[start], count[origin], start[origin], least[start[origin]])


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(chunk, blob): rows in compressed chunks of about ``limit`` bytes of text, or of one longer text.

    Chunks are numbered by task. Rows are sorted in each task before they are cut, so a chunk that is lost is cut alike
    again, in whatever order its rows arrive.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for h in held:
                    out.write_batch(h)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy()
            at = 0
            for k, n in enumerate(lengths.tolist()):
                if size and size + n > limit:
                    if k > at:
                        held.append(b.slice(at, k - at))
                    yield row()
                    held, size, number, at = [], 0, number + 1, k
                size += n
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield row()

    dealt = spread(docs)
    return dealt.sortWithinPartitions(F.col(id_col), F.xxhash64(*map(F.col, dealt.columns))).mapInArrow(run, "chunk long, blob binary")


def open_chunk(blob: bytes, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """(rows, ids, texts); a null id counts as larger than all others, a null text is empty."""
    rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    ids = pc.fill_null(rows[id_col].cast(pa.int64()), _NO_DOC).to_numpy()
    return rows, ids, [t or b"" for t in rows[text_col].cast(pa.binary()).to_pylist()]


def shard_windows(minimizer: np.ndarray, doc: np.ndarray, many: np.ndarray, windows: np.ndarray, texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments of one shard: which have windows to report, the reported windows' number by segment, the smallest document of each.

    doc: smallest document that has the segment in its chunk. many: more than one occurrence there.
    """
    order = np.argsort(minimizer, kind="stable")
    same = minimizer[order][1:] == minimizer[order][:-1]
    keep = many.copy()
    keep[order[1:][same]] = keep[order[:-1][same]] = True
    kept = np.flatnonzero(keep)
    if not len(kept):
        return kept, np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = b"".join([texts[k] for k in kept.tolist()])
    starts, lengths = word_spans(text)
    symbols = factorize(text, starts, lengths)[0]
    del text, starts, lengths
    trim()
    size = windows[kept] + span - 1
    head = offsets(size)[:-1]
    code, first = distinct_runs(symbols.astype(np.uint64), head, size)
    least = np.full(len(first), _NO_DOC)
    np.minimum.at(least, code, doc[kept])
    # The indexed text: the distinct segments, each with a separator behind.
    own = size[first]
    place = offsets(own + 1)[:-1]
    indexed = np.zeros(int(own.sum()) + len(own), np.int64)
    inside = ragged(np.arange(len(indexed)), place, own)
    streamed = ragged(symbols, head[first], own) + 1
    indexed[inside] = streamed
    index = FMIndex(indexed, span, np.repeat(least, own + 1))
    del indexed, inside, symbols
    trim()
    # The segments are streamed through it.
    n = windows[kept][first]
    at, done = offsets(own), offsets(n)
    smallest = np.repeat(least, n)
    told_of = np.full(index.matrix.size, -1, np.int64)  # what an interval's first suffix has been found to be
    for a, z in _blocks(done, BLOCK):
        starts = ragged(np.arange(int(at[z] - at[a])), at[a:z] - at[a], n[a:z])
        matched, low, high = index.matching(streamed[at[a] : at[z]], starts)
        hit = np.flatnonzero(matched == span)
        fresh, one = np.unique(low[hit], return_index=True)
        one = one[told_of[fresh] < 0]
        told_of[low[hit[one]]] = np.searchsorted(index.names, index.least(low[hit[one]], high[hit[one]]))
        smallest[done[a] : done[z]][hit] = index.names[told_of[low[hit]]]
    each = windows[kept]
    answer = ragged(smallest, done[code], each)
    told = many[kept] | (np.minimum.reduceat(answer, offsets(each)[:-1]) < doc[kept])
    return kept[told], each[told], answer[np.repeat(told, each)]


def _blocks(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items that hold at most ``limit`` together, or one that holds more; ends: running sums."""
    a = 0
    while a < len(ends) - 1:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        yield a, z
        a = z


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[dict]]]:
    """Rows with equal keys, which come one after the other."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = r[b.schema.names[key]]
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(r)
    if rows:
        yield now, rows


def removed_words(chunk: Chunk, replies: list[bytes], span: int) -> np.ndarray:
    """Whether each word is covered by a window that also starts in a smaller document."""
    covered = np.zeros(len(chunk.at), np.int64)
    if replies:
        parts = [unpack(r, np.int32, np.int16, np.int64) for r in replies]
        code, count, small = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
        where = np.full(len(chunk.windows), -1)
        where[code] = np.arange(len(code))
        base = offsets(count)[:-1]
        seen = np.flatnonzero(where[chunk.code] >= 0)
        row = where[chunk.code[seen]]
        n = count[row]
        smallest = ragged(small, base[row], n)
        begin = np.repeat(chunk.start[seen], n) + np.arange(len(smallest)) - np.repeat(offsets(n)[:-1], n)
        hit = begin[smallest < np.repeat(chunk.ids[chunk.doc[seen]], n)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + span, -1)
    return np.cumsum(covered)[:-1] > 0


def kept_texts(chunk: Chunk, removed: np.ndarray) -> list[bytes]:
    """The words that stay, joined by one blank, of each document."""
    stay = np.flatnonzero(~removed)
    size = np.diff(chunk.at)[stay]
    text = ragged(np.frombuffer(chunk.text, np.uint8), chunk.at[:-1][stay], size).tobytes()
    ends = offsets(size)[np.append(0, np.cumsum(~removed))[chunk.first]].tolist()
    return [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


def _answers(docs: DataFrame, span: int, seed: int, id_col: str, text_col: str, finish, schema) -> DataFrame:
    """Runs the shards and applies ``finish(rows, chunk, texts, removed)`` to every chunk."""
    if not seed <= span < 1 << 15:
        raise ValueError(f"windows have from {seed} to {(1 << 15) - 1} words")
    prepare(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A task has several shards where the table is large, one after the other.
    shards = max(parts, -(-(stored_bytes(docs) or 0) // SHARD))
    # One shuffle of the chunks serves both readers below.
    packed = pack_chunks(docs, id_col, text_col, CHUNK).repartition(parts, "chunk")

    def send(batches):
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, ids, texts = open_chunk(blob, id_col, text_col)
                c = cut(ids, texts, span, seed)
                if not len(c.windows):
                    continue
                many = np.bincount(c.code, minlength=len(c.windows)) > 1
                small = np.full(len(c.windows), _NO_DOC)
                np.minimum.at(small, c.code, ids[c.doc])
                target = (c.minimizer & np.uint64(0xFFFFFFFF)) % np.uint64(shards)
                brief = (c.minimizer >> np.uint64(32)).astype(np.uint32)  # tells minimizers of a shard apart but for a few
                order = np.argsort(target, kind="stable")
                bounds = np.searchsorted(target[order], np.arange(shards + 1, dtype=np.uint64))
                a, z = c.at[c.origin], c.at[c.origin + c.windows + span - 1]
                for t in np.flatnonzero(np.diff(bounds)).tolist():
                    k = order[bounds[t] : bounds[t + 1]]
                    text = b"".join([c.text[x:y] for x, y in zip(a[k].tolist(), z[k].tolist(), strict=True)])
                    blob = pack(np.diff(k, prepend=0).astype(np.int32), brief[k], np.diff(small[k], prepend=0), many[k], c.windows[k].astype(np.int16), text, level=6)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["target", "chunk", "blob"])

    def search(batches):
        for _, rows in _groups(batches, 0):
            parts_of = [unpack(r["blob"], np.int32, np.uint32, np.int64, np.bool_, np.int16, None) for r in rows]
            number, doc = (np.concatenate([np.cumsum(p[k], dtype=np.int64) for p in parts_of]) for k in (0, 2))
            minimizer, many, windows = (np.concatenate([p[k] for p in parts_of]) for k in (1, 3, 4))
            texts: list[bytes] = []
            for p in parts_of:
                blanks = np.flatnonzero(np.frombuffer(p[5], np.uint8) == 0x20) + 1
                at = [0, *blanks[np.cumsum(p[4].astype(np.int64) + (span - 1)) - 1].tolist()]
                texts += [p[5][x:y] for x, y in zip(at, at[1:], strict=False)]
            bounds = offsets(np.array([len(p[0]) for p in parts_of]))
            chunk_of = [r["chunk"] for r in rows]
            del parts_of, rows
            told, count, small = shard_windows(minimizer, doc, many, windows.astype(np.int64), texts, span)
            cuts = np.searchsorted(told, bounds)
            at = offsets(count)
            for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if x < y:
                    blob = pack(number[told[x:y]].astype(np.int32), count[x:y].astype(np.int16), small[at[x] : at[y]], level=3)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk_of[k]], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "reply"])

    def apply(batches):
        for b in batches:
            for blob, replies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, ids, texts = open_chunk(blob, id_col, text_col)
                c = cut(ids, texts, span, seed)
                yield from finish(rows, c, texts, removed_words(c, replies or [], span))

    sent = packed.mapInArrow(tidy(send), "target int, chunk long, blob binary")
    replies = sent.repartitionById(parts, F.col("target") % parts).sortWithinPartitions("target").mapInArrow(tidy(search), "chunk long, reply binary")
    # A chunk's replies are bounded by its size.
    return packed.join(replies.groupBy("chunk").agg(F.collect_list("reply").alias("replies")), "chunk", "left").select("blob", "replies").mapInArrow(tidy(apply), schema)


def _counts(c: Chunk, removed: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array(np.diff(c.first)), pa.array(np.diff(offsets(removed)[c.first]))


def _intervals(c: Chunk, removed: np.ndarray) -> pa.Array:
    out = []
    for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True):
        edges = np.flatnonzero(np.diff(removed[a:b].astype(np.int8), prepend=0, append=0)).tolist()
        out.append([{"first": x, "last": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


def remove_repeats(docs: DataFrame, span: int = 13, seed: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): every document without the words that smaller documents' windows cover.

    A window is ``span`` words in a row of one document; its words go if the same words in a row also start in a
    document with a smaller id. Windows are judged on the input. Words are unchanged. A null or
    empty text has no words; a document with a null id counts as larger than all others; rows that repeat an
    id are one document, so none of them is smaller. An empty table gives no rows; a very long text is handled alone, whole. Other
    columns are pruned. ``kept`` holds the kept words, joined by one blank; ``removed`` the intervals of removed words (first, last + 1).
    """

    def finish(rows: pa.Table, c: Chunk, texts: list[bytes], removed: np.ndarray):
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *_counts(c, removed), pa.array(kept_texts(c, removed), pa.binary()), _intervals(c, removed)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return _answers(texts_of(docs, id_col, text_col), span, seed, "doc_id", "text", finish, "doc_id long, n_words long, n_removed long, kept binary, removed array<struct<first: int, last: int>>")


def repeat_digests(docs: DataFrame, span: int = 13, seed: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): as ``remove_repeats``, with a digest in place of the kept words."""

    def finish(rows: pa.Table, c: Chunk, texts: list[bytes], removed: np.ndarray):
        digests = [hashlib.sha256(t).hexdigest() for t in kept_texts(c, removed)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *_counts(c, removed), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _answers(texts_of(docs, id_col, text_col), span, seed, "doc_id", "text", finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_words(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the removed words and the blanks behind each; all else is as it was."""
    starts, _ = word_spans(text)
    edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
    bounds = np.append(starts, len(text))[edges].tolist()
    return b"".join(text[a:b] for a, b in zip([0, *bounds[1::2]], [*bounds[::2], len(text)], strict=True))


def drop_repeats(docs: DataFrame, span: int = 50, seed: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, where repeated windows are cut out of the texts; untouched texts stay as they are.

    Words and windows are as for ``remove_repeats``. Null texts stay null, empty ones empty; rows that repeat an id are one document and
    all stay; an empty table gives no rows. Columns of any other name pass through.
    """

    def finish(rows: pa.Table, c: Chunk, texts: list[bytes], removed: np.ndarray):
        gone = offsets(removed)[c.first]
        column = rows[text_col].to_pylist()
        for k in np.flatnonzero(np.diff(gone)).tolist():
            column[k] = without_words(texts[k], removed[c.first[k] : c.first[k + 1]]).decode("utf-8", "replace")
        place = rows.schema.get_field_index(text_col)
        yield from rows.set_column(place, rows.schema.field(place), pa.array(column, rows.schema.field(place).type)).combine_chunks().to_batches()

    return _answers(docs, span, seed, id_col, text_col, finish, docs.schema)
