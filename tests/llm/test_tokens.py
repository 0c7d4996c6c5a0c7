from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import bpe, bpe_columns, queries, token_counts

PARTS = ["'", " ", "  ", "\n", "\t", "a", "s", "re", "ll", "'ve", "'S", "1", "23", "é", "漢字", "!", "?!", "　", " ", "\0", "😀", "́", "▁", "the", " the", "<|endoftext|>", "</s>", "\r\n"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def tools():
    own = bpe.from_rank_file(queries.MULTI_RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, lib, bpe.from_json_file(queries.BYTE_JSON), Tokenizer.from_file(queries.BYTE_JSON)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6))
def test_same_as_the_libraries(tools, batch):
    own, lib, own_json, lib_json = tools
    flat, first = own.encode(batch)
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [lib.encode_ordinary(t) for t in batch]
    flat, first = own_json.encode(batch)
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [x.ids for x in lib_json.encode_batch(batch, add_special_tokens=False)]


def test_long_pieces(tools):
    own, lib, _, _ = tools
    for t in ("a" * 5000, "!?" * 2000, " " * 3000, "漢" * 700, "ab" * 33):
        assert own.encode([t])[0].tolist() == lib.encode_ordinary(t)


def test_scan_of_blocks_equals_the_automaton():
    rng = np.random.default_rng(1)
    ids, compose, _, _ = bpe._monoid()
    symbols = rng.integers(0, 9, 5000)
    got = bpe._scan(ids[symbols], compose)
    x = 0
    for k, s in enumerate(symbols.tolist()):
        assert got[k] == x
        x = int(compose[x, ids[s]])


def test_columns(spark):
    rows = [(1, "It's  a test\n"), (2, None), (3, "x" * 9999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = bpe_columns.encode_column(docs, queries.MULTI_RANKS)
    back = {r["doc_id"]: bytes(r["text"]) for r in bpe_columns.decode_column(encoded, queries.MULTI_RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    own = bpe.from_rank_file(queries.MULTI_RANKS)
    for r in encoded.collect():
        assert r["ends"] == np.cumsum([len(own.token[k]) for k in r["ids"]]).tolist()
    for r in bpe_columns.round_trip(docs, queries.MULTI_RANKS).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = own.encode([text])[0].tolist()
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_slices_are_decoded_by_their_offsets(spark):
    text = "It's Ünïcödé 漢字 😀, twice: Ünïcödé 漢字 😀\n" * 3
    data = text.encode()
    encoded = bpe_columns.encode_column(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), queries.MULTI_RANKS)
    places = [(a, z) for a in (-1, 0, 1, 7, 30, len(data) - 1, len(data)) for z in (0, 1, 8, 31, 90, len(data), len(data) + 5)]
    asked = encoded.join(spark.createDataFrame([(d, a, z) for d in (1, 2) for a, z in places], "doc_id long, first int, last int"), "doc_id")
    got = asked.select("doc_id", "first", "last").collect()
    found = bpe_columns.decode_between(asked, queries.MULTI_RANKS).collect()
    want = sorted((r["doc_id"], (data if r["doc_id"] == 1 else b"")[max(0, r["first"]) : r["last"]]) for r in got)
    assert sorted((r["doc_id"], bytes(r["text"])) for r in found) == want and len(want) == 2 * len(places)


@pytest.fixture(scope="module")
def pieces():
    return token_counts.counter(queries.PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=4))
def test_counts_of_every_prefix(pieces, batch):
    own, lib = pieces
    assert own.totals(batch).tolist() == [len(x) for x in lib.encode(batch)] if batch else True
    for t, prefix in zip(batch, own.prefixes(batch), strict=True):
        assert prefix.tolist() == [len(lib.encode(t[:k])) for k in range(len(t) + 1)]


def test_budget_needs_no_second_encoding(spark, pieces):
    own, lib = pieces
    text = "It was the best of times, it was the worst of times. " * 5
    prefix = own.prefixes([text])[0]
    k = token_counts.longest_within(prefix, 20)
    assert len(lib.encode(text[:k])) <= 20 < len(lib.encode(text[: k + 1]))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    stored = token_counts.store_prefixes(docs, queries.PIECE_MODEL)
    answered = stored.selectExpr("doc_id", "array_max(filter(sequence(0, size(counts) - 1), k -> counts[k] <= 20)) AS cut")
    assert {r["doc_id"]: r["cut"] for r in answered.collect()} == {1: k, 2: 0}
    got = token_counts.token_counts(docs, queries.PIECE_MODEL, limit=20).where("doc_id = 1").first()
    assert got["over_limit"] and got["chars_within"] == k and got["n_tokens"] == prefix[-1]
