from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import fm_index, repeats


def slow(rows, span=13):
    """{place in rows: (words, removed flags)}"""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        key = float("inf") if i is None else i
        for k in range(len(w) - span + 1):
            x = tuple(w[k : k + span])
            first[x] = min(first.get(x, float("inf")), key)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        key = float("inf") if i is None else i
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < key:
                gone[k : k + span] = [True] * span
        out.append((w, gone))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.integers(1, 6))
def test_index_finds_all_windows(symbols, depth):
    text = np.array([*symbols, 0], np.int64)
    index = fm_index.FMIndex(text, depth)
    starts = np.arange(max(0, len(symbols) - depth + 1))
    matched, low, high = index.matching(text, starts, 1)
    for s, m, a, b in zip(starts.tolist(), matched.tolist(), low.tolist(), high.tolist(), strict=True):
        want = [k for k in range(len(symbols) - depth + 1) if symbols[k : k + depth] == symbols[s : s + depth]]
        assert m == depth and sorted(index.documents[a:b].tolist()) == want and index.least(np.array([a]), np.array([b]))[0] == want[0]
    matched, _, _ = index.matching(text, starts, 2)
    for s, m in zip(starts.tolist(), matched.tolist(), strict=True):
        end = s + depth
        most = max((n for n in range(1, depth + 1) if sum(symbols[k : k + n] == symbols[end - n : end] for k in range(len(symbols) - n + 1)) >= 2), default=1)
        assert m == most


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        w = fm_index.WaveletMatrix(rng.integers(0, 7, n))
        at = np.arange(n + 1)
        bits = np.unpackbits(w.words[0].view(np.uint8), bitorder="little")[:n]
        assert w.rank(0, at).tolist() == np.append(0, np.cumsum(bits)).tolist()


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "W1", "x" * 40]
    passages = [" ".join(rng.choice(vocabulary, int(rng.integers(5, 60)))) for _ in range(8)]
    rows = []
    for k in rng.permutation(n).tolist():
        parts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))) for _ in range(3)]
        parts.insert(int(rng.integers(0, 4)), passages[int(rng.integers(8))])
        rows.append((k, ("\n" if k % 2 else "  ").join(parts)))
    rows += [(500, None), (501, ""), (None, passages[0]), (502, passages[0]), (502, passages[0]), (503, " ".join(["same"] * 80)), (3, passages[1])]
    return rows


@pytest.mark.parametrize("span", [13, 50])
def test_against_all_windows(spark, span):
    rows = corpus(span)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, _), (w, g) in zip(rows, slow(rows, span), strict=True)), key=str)
    assert sorted(map(tuple, repeats.repeat_digests(docs, span).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0
    kept = {(r["doc_id"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(docs, span).collect()}
    assert kept == {(i, g, h) for i, _, g, h in want}


def digests(rows, span=13):
    return sorted(((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, _), (w, g) in zip(rows, slow(rows, span), strict=True)), key=str)


def test_many_chunks_shards_and_blocks(spark, monkeypatch):
    """Chunks of 2 KB, shards of 1 KB (several in a task), blocks of 64 windows."""
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    monkeypatch.setattr(repeats, "SHARD", 1000)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    monkeypatch.setattr(repeats, "stored_bytes", lambda df: 40_000)
    rows = corpus(99, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats.pack_chunks(docs, "doc_id", "text", 2000).count() > 20
    assert sorted(map(tuple, repeats.repeat_digests(docs).collect()), key=str) == digests(rows)


def test_chunks_do_not_depend_on_the_order_of_rows(spark):
    """Rows of a lost task arrive in another order: the same chunks under the same numbers come out."""
    rows = corpus(7, 200)
    made = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3, "doc_id")
        made.append(sorted((r["chunk"], bytes(r["blob"])) for r in repeats.pack_chunks(docs, "doc_id", "text", 1500).collect()))
    assert made[0] == made[1] and len(made[0]) > 10


def test_segments_are_windows_of_one_minimizer():
    rows = corpus(99, 300)
    ids = np.array([i if i is not None else repeats._NO_DOC for i, _ in rows])
    texts = [(t or "").encode() for _, t in rows]
    whole = repeats.cut(ids, texts, 13, 4)
    for (w, _), a, b in zip(slow(rows), whole.first[:-1], whole.first[1:], strict=True):
        assert whole.text[whole.at[a] : whole.at[b]].split() == w
    assert (whole.windows <= 13 - 4 + 1).all()


def test_long_windows(spark):
    """More words than a byte counts; spans beyond the integers' width are refused."""
    words = [f"w{k % 977}" for k in range(1500)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[100:1100])), (3, " ".join(words[:150]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.repeat_digests(docs, 200).collect())) == digests(rows, 200)
    with pytest.raises(ValueError, match="words"):
        repeats.repeat_digests(docs, 40_000)


def test_intervals_and_empty_tables(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b " + " ".join(words[5:25]) + " c")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: [], 2: [(2, 22)]}
    assert repeats.remove_repeats(docs.limit(0)).count() == 0 and repeats.drop_repeats(docs.limit(0)).count() == 0


def test_index_is_small():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 4000, 200_000), 0)
    index = fm_index.FMIndex(text, 13, np.arange(len(text)) // 100)
    assert index.nbytes < 0.65 * 8 * len(text)  # less than a code and a place of 32 bits each for every symbol


def test_cut_texts_keep_everything_else():
    text = b" a  b\nc d\te "
    assert repeats.without_words(text, np.array([False, True, True, False, False])) == b" a  d\te "
    assert repeats.without_words(text, np.ones(5, bool)) == b" "
    assert repeats.without_words(text, np.zeros(5, bool)) == text
    assert repeats.without_words(b"", np.zeros(0, bool)) == b""
