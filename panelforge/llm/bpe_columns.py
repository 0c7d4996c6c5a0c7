"""Byte-level BPE over a table: encoding, decoding with offsets, and digests of both."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import chunks, offsets, prepare, ragged, spread, texts_of


def decoded(texts: list[bytes]) -> list[str]:
    """Texts as strings; bytes that are no UTF-8 become U+FFFD."""
    return [t.decode("utf-8", "replace") for t in texts]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, ends array<int>): the ids of each text and the byte offset where each ends.

    A null text is empty and has no ids; a very long one is encoded whole; repeated rows give repeated rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        encoder = bpe.from_rank_file(path)
        for ids, texts in chunks(batches):
            flat, first = encoder.encode(decoded(texts))
            spans = encoder.token_spans(flat)
            ends = spans[1:] - np.repeat(spans[first[:-1]], np.diff(first))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.astype(np.int32))) for x in (flat, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "ids", "ends"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, ids array<int>, ends array<int>")


def decode_column(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text binary) of (doc_id, ids); null ids give an empty text."""
    prepare(tokens.sparkSession)

    def run(batches):
        encoder = bpe.from_rank_file(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def decode_between(tokens: DataFrame, path: str, first: str = "first", last: str = "last") -> DataFrame:
    """(doc_id, text binary) of (doc_id, ids, ends) and two columns of byte places: the bytes from the first up to the last one.

    The offsets tell which tokens hold them; no others are decoded. Places beyond the text are cut to it; a null in any column gives null.
    """
    prepare(tokens.sparkSession)

    def run(batches):
        encoder = bpe.from_rank_file(path)
        for b in batches:
            out = []
            for ids, ends, a, z in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if ids is None or ends is None or a is None or z is None:
                    out.append(None)
                    continue
                a, z = max(a, 0), min(z, ends[-1] if ends else 0)
                if a >= z:
                    out.append(b"")
                    continue
                i, j = bisect.bisect_right(ends, a), bisect.bisect_left(ends, z) + 1
                begin = ends[i - 1] if i else 0
                out.append(encoder.decode(ids[i:j])[a - begin : z - begin])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids", "ends", first, last).mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    The ids' digest is over their decimals joined by commas, the other one over the bytes that the
    ids decode to. A null text is empty: no tokens, digests of the empty string. Equal texts give equal rows; an empty table gives
    none; other columns are pruned.
    """
    prepare(docs.sparkSession)

    def run(batches):
        encoder = bpe.from_rank_file(path)
        for ids, texts in chunks(batches):
            codes, known, first = encoder.encode_pieces(decoded(texts))
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat, at = np.frombuffer(b"".join(known), "<u4"), offsets(sizes)
            tokens = flat.tolist()
            decimals = [encoder.decimal[k] for k in tokens]
            bounds = at.tolist()
            listed = [",".join(decimals[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            all_ids, starts = ragged(flat, at[:-1][codes], sizes[codes]), offsets(sizes[codes])[first]
            # All ids of the chunk are decoded at once; the offsets kept for each token tell where a text begins and ends.
            data, cuts = encoder.decode(all_ids.tolist()), encoder.token_spans(all_ids)[starts].tolist()
            order, pieces = codes.tolist(), first.tolist()
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([sha(",".join(map(listed.__getitem__, order[a:b])).encode()) for a, b in zip(pieces, pieces[1:], strict=False)]),
                    pa.array([sha(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
