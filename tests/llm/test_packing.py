from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import packing, queries


def bins_of(rows):
    """{bin: [(offset, length)]} of a plan."""
    out: dict[int, list] = {}
    for length, _, n, first, each, offset in rows.tolist():
        for t in range(n):
            out.setdefault(first + t // each, []).append((offset + t % each * length, length))
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20), st.integers(1, 8), st.integers(100, 1024), st.sampled_from(["norm", "dot"]))
def test_plan_holds_all_capacities(counts, documents, attention, rule):
    limits = packing.Capacities(32, documents, max(attention, 32 * 32))
    rows = packing.plan(counts, limits, rule=rule)
    for length, n in counts.items():
        own = rows[rows[:, 0] == length]
        assert own[:, 2].sum() == n and own[:, 1].tolist() == np.append(0, np.cumsum(own[:, 2]))[:-1].tolist()
    for items in bins_of(rows).values():
        items.sort()
        assert [o for o, _ in items] == np.append(0, np.cumsum([n for _, n in items]))[:-1].tolist()
        assert sum(n for _, n in items) <= 32 and len(items) <= documents and sum(n * n for _, n in items) <= limits.attention


def test_each_capacity_can_bind():
    rng = np.random.default_rng(2)
    counts: dict[int, int] = {}
    for n in [*rng.integers(1, 60, 400).tolist(), *rng.integers(900, 1025, 200).tolist()]:
        counts[n] = counts.get(n, 0) + 1
    limits = packing.TIGHT
    bins = bins_of(packing.plan(counts, limits)).values()
    documents, attention = [len(b) for b in bins], [sum(n * n for _, n in b) for b in bins]
    assert max(documents) == limits.documents and max(attention) > 0.9 * limits.attention
    least = max(-(-sum(n * k for n, k in counts.items()) // limits.tokens), -(-sum(counts.values()) // limits.documents), -(-sum(n * n * k for n, k in counts.items()) // limits.attention))
    alone = bins_of(packing.plan(counts, packing.Capacities(limits.tokens, 10**6, 10**12)))
    assert len(alone) < least <= len(bins) <= least + 12  # tokens alone would need fewer


def slow_best_fit(lengths, size):
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_as_few_bins_as_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.plan(counts, packing.Capacities(64, 64, 64 * 64))
    assert len(bins_of(rows)) <= slow_best_fit(lengths, 64)


def test_too_long_a_piece():
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan({9: 1}, packing.Capacities(8, 8, 64))
    assert packing.plan({}, packing.Capacities()).shape == (0, 6)


def test_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta'll"], int(rng.integers(0, 900))))) for k in range(60)]
    rows += [(100 + k, "hot") for k in range(300)] + [(1000, None), (1001, "<|endoftext|>x"), (1002, "word " * 30_000), (7, "again")]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_JSON).collect()
    lib = Tokenizer.from_file(queries.BYTE_JSON)
    want = sorted((i, len(ids := [*lib.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids[-1024:], "<u4").tobytes())) for i, t in rows if i != 7)
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, n, last in want:
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == n
        assert all(r["length"] == 1024 for r in pieces[1:]) and pieces[-1]["ids_crc32"] == last
        assert [r["start"] for r in pieces] == np.append(0, np.cumsum([r["length"] for r in pieces]))[:-1].tolist()
    assert len(by_doc[7]) >= 2
    at: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and len(at) <= -(-sum(r["length"] for r in got) // 1024) + 1
