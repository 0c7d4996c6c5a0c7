from __future__ import annotations

import heapq
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import ann, simhash
from panelforge.llm.graph import components

DATA = Path("/root/testdata")


def slow_print(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_golay_code():
    words = np.arange(1 << 23)
    home, _ = simhash.nearest_anchor(words)
    low, high, _ = simhash._code()
    anchor = np.full(4096, -1)
    whole = words[(low[words & 0xFFF] ^ high[words >> 12]) == 0]
    assert len(whole) == 4096
    anchor[whole >> 11] = whole
    assert np.bitwise_count(words ^ anchor[home]).max() == simhash.RADIUS


def test_neighbours_within_two_bits_share_an_anchor():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(300):
        for b in rng.choice(64, k % 3, replace=False).tolist():
            y[k] ^= np.uint64(1 << b)
    plan = simhash.Plan()
    row, anchor, home = simhash.anchors(x[:, None], plan)
    home_of = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    row, anchor, _ = simhash.anchors(y[:, None], plan)
    reached = {(r, a) for r, a in zip(row.tolist(), anchor.tolist(), strict=True)}
    assert len(home_of) == 300 and all((k, home_of[k]) in reached for k in range(300))


def test_large_groups_are_linked_like_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (4, 1), dtype=np.uint64)
    prints = np.concatenate([base[k % 4] ^ np.uint64(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 5), replace=False))) for k in range(400)])[:, None]
    edges = [(int(a), int(b)) for left, right in simhash.links(prints, 2) for a, b in zip(left, right, strict=True)]
    assert all(np.bitwise_count(prints[a] ^ prints[b])[0] <= 2 for a, b in edges) and len(edges) < 4000
    pairs = [(i, j) for i in range(400) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j])[0] <= 2]
    assert slow_components(range(400), edges) == slow_components(range(400), pairs)


@pytest.mark.parametrize(("large", "batch"), [(simhash.LARGE, "10000"), (3, "2")])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, large, batch):
    """Also where an anchor has more rows than a task may hold, and they come in several batches."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(25):
        words = rng.choice(vocabulary, int(rng.integers(1, 200))).tolist()
        for _ in range(int(rng.integers(1, 8))):
            own = list(words)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            rows.append((n := n + 3, " ".join(own).title()))
    rows += [(1, None), (2, " \n"), (4, "one"), (5, "ONE"), (7, "one two")]
    crowded, split = simhash.crowded_links, []
    monkeypatch.setattr(simhash, "crowded_links", lambda *a: split.append(a) or crowded(*a))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), large=large).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(split) == (large == 3)
    got = {r["doc_id"]: (int(r["print"].hex(), 16), r["component_id"]) for r in found}
    prints = {i: slow_print(t) for i, t in rows}
    ids = sorted(prints)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = slow_components(ids, edges)
    assert got == {i: (prints[i], want[i]) for i in ids}


def test_crowded_anchors_are_linked_like_pairs(spark):
    """Anchors dealt into parts lose no link: near the least id, far from it, and of ids with several fingerprints."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 6).tolist()
    rows = []
    for k in range(300):
        value = base[k % 6] ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 5), replace=False))
        rows.append((int(rng.integers(2)), int(rng.integers(200)), value))
    frame = spark.createDataFrame([(a, r, v.to_bytes(8, "big")) for a, r, v in rows], "anchor long, rep long, print binary").distinct()
    got = [(r.a, r.b) for r in simhash.crowded_links(frame, simhash.Plan(), 20).collect()]
    pairs = [(r, q) for k, (a, r, v) in enumerate(rows) for b, q, w in rows[:k] if a == b and (v ^ w).bit_count() <= 2]
    assert slow_components(range(200), got) == slow_components(range(200), pairs)


def test_anchors_grow_with_the_corpus():
    """Pairs of unlike fingerprints stay bounded, and pairs of bits that differ at 0.151 share a home."""
    home = simhash._hamming()
    word = np.arange(128)
    code = {int(h): [w for w in word if home[w] == h] for h in range(16)}
    assert all(len(ws) == 8 and min(max(int(w ^ c).bit_count() for w in ws) for c in ws) == 1 for ws in code.values())
    rng = np.random.default_rng(4)
    for texts in (10**3, 10**6, 10**8, 10**10):
        plan = simhash.near_plan(texts)
        anchors = 4096 * 16 ** (len(plan.tables[0]) - 1)
        assert len(plan.tables) * texts / anchors <= simhash.PAIRS
        if texts == 10**8:
            x = rng.integers(0, 1 << 63, (400, 10), dtype=np.uint64)
            flips = np.packbits(rng.random((400, 640)) < 0.151, axis=1, bitorder="little").view("<u8")
            both = [simhash.anchors(p, plan)[:2] for p in (x, x ^ flips)]
            (r, a), (q, b) = both
            near = set(zip(r.tolist(), a.tolist(), strict=True)) & set(zip(q.tolist(), b.tolist(), strict=True))
            assert len({k for k, _ in near}) >= 392
            far = simhash.anchors(rng.integers(0, 1 << 63, (400, 10), dtype=np.uint64), plan)[1]
            assert len(set(far.tolist())) > 0.9 * len(far)


def test_near_plan_finds_similar_texts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        words = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(words)))
        if k < 30:
            for at in rng.choice(300, 4, replace=False).tolist():  # a similarity of about 0.88
                words[at] = "changed"
            rows.append((2 * k + 1, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.near_plan()).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(30)) >= 29
    assert all(got[2 * k] == 2 * k for k in range(60))


def five_words(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b)


def near_pairs(low, high, count, seed, length=300):
    """Texts of random words and a changed copy of each, of a similarity from ``low`` up to ``high``."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < count:
        words = [f"v{x}" for x in rng.integers(0, 5000, length)]
        own = list(words)
        for at in rng.choice(length, int(rng.integers(4, 14)), replace=False).tolist():
            own[at] = "changed"
        if low <= alike(five_words(" ".join(words)), five_words(" ".join(own))) < high:
            out.append((" ".join(words), " ".join(own)))
    return out


def near_groups(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows, simhash.near_plan()).collect()}


def test_near_plan_leaves_texts_below_its_similarity(spark):
    texts = [t for pair in near_pairs(0.70, 0.79, 80, 5) for t in pair]
    rng = np.random.default_rng(6)
    line = " ".join(f"l{k}" for k in range(10)) + "\n"
    for _ in range(2):  # one line in common many times, the rest their own
        texts.append(line * 60 + " ".join(f"v{x}" for x in rng.integers(0, 5000, 60)))
    assert near_groups(spark, texts) == {k: k for k in range(len(texts))}


def test_near_plan_finds_texts_at_its_similarity(spark):
    texts = [t for pair in near_pairs(0.80, 0.82, 150, 9) for t in pair]
    got = near_groups(spark, texts)
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 148


def test_groups_are_parted_like_all_pairs(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(3):
        words = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(40):  # copies of a copy: similar ones and others in a group
            words = list(words)
            for at in rng.choice(120, int(rng.integers(0, 8)), replace=False).tolist():
                words[at] = f"c{rng.integers(0, 5000)}"
            texts.append(" ".join(words))
    ids = rng.permutation(len(texts)).tolist()
    sets = dict(zip(ids, map(five_words, texts), strict=True))
    want = slow_components(ids, [(a, b) for a in ids for b in range(a) if alike(sets[a], sets[b]) >= 0.8])
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    least = {k: min(ids[k // 40 * 40 : k // 40 * 40 + 40]) for k in range(len(ids))}
    found = spark.createDataFrame([(ids[k], least[k]) for k in range(len(ids))], "node long, component long")
    for part in (7, 256):
        got = {r["node"]: r["component"] for r in simhash.exact_components(docs, found, simhash.near_plan(), part).collect()}
        assert {i: got.get(i, i) for i in ids} == want
    assert 3 < len(set(want.values())) < len(ids)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(1, 60)], [(1000, k) for k in range(1, 60)], [(5, 5), (7, 5), (5, 7), (9, 8)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = slow_components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    left, right = simhash.stars(a, b)
    assert slow_components(nodes, [e for e in zip(left.tolist(), right.tolist(), strict=True)]) == want


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def exact(ids, x, k=5, every=50):
    out = {}
    norm = np.sqrt((x * x).sum(axis=1))
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found: dict[int, list] = {}
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


@pytest.mark.parametrize(("n", "dim"), [(3000, 16), (700, 8)])
def test_recall(spark, n, dim):
    x = clusters(n, dim, 4)
    want = exact(np.arange(n), x.astype(np.float64))
    got = search(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize(("scale", "most"), [("sf0.01", 0.35), ("sf0.1", 0.2)])
def test_recall_and_scored_rows_on_given_vectors(spark, scale, most):
    """Vectors almost without near neighbours: the forest scores a small part of the rows and finds nine of ten."""
    rows = spark.read.parquet(f"{DATA}/{scale}/embeddings.parquet")
    t = rows.select("vec_id", "embedding").toArrow()
    ids, x = t["vec_id"].to_numpy(), ann._matrix(t["embedding"]).astype(np.float64)
    want = exact(ids, x)
    got = ann.nearest(rows).collect()
    found: dict[int, set] = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(found[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert np.mean(list({r["query_id"]: r["n_scored"] for r in got}.values())) <= most * len(ids)


def test_queue_hands_out_leaves_by_cost():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6))
    tree = ann.grow(x, 10, rng)
    q = rng.standard_normal((4, 6))
    for j, cost in enumerate(tree.costs(q).T):
        queue, order = [(0.0, 0)], []
        while queue:  # nodes, as a queue would walk them
            c, node = heapq.heappop(queue)
            if node < 0:
                order.append((c, -1 - node))
                continue
            m = float(tree.normals[node] @ q[j] - tree.thresholds[node])
            heapq.heappush(queue, (c + max(m, 0), int(tree.children[node, 0])))
            heapq.heappush(queue, (c + max(-m, 0), int(tree.children[node, 1])))
        assert [c for c, _ in order] == pytest.approx(sorted(cost)) and sorted(k for _, k in order) == list(range(len(tree.sizes)))
        assert cost[tree.leaves(q)[j]] == 0


def test_an_id_with_several_vectors_is_as_near_as_its_nearest(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (3, [1.0, 0.1], 0), (3, [-1.0, 0.0], 0), (4, [0.3, 1.0], 0), (5, [-1.0, -1.0], 0)]
    got = search(spark, rows)[0]
    assert [a for a, _ in got] == [3, 4, 5] and got[0][1] == pytest.approx(1 / 1.01**0.5) and got[1][1] == pytest.approx(1 / 1.09**0.5)


def test_clashing_columns_and_questions_in_blocks(spark):
    x = clusters(300, 8, 2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for c in ("id", "v", "leaf", "home", "cell", "rank", "score", "query_id"):
        df = df.withColumn(c, F.lit(1))
    want = sorted(map(tuple, ann.nearest(df.select("vec_id", "embedding")).collect()))
    assert sorted(map(tuple, ann.nearest(df, settings=ann.Settings(block=2)).collect())) == want and len(want) == 30


def test_few_and_bad_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [0.0, 2.0], 0), (3, [1.0, 1.0], 0), (4, [2.0, 2.0], 0), (5, None, 0), (6, [0.0, 0.0], 0), (7, [None, 1.0], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (100, [0.0, 0.0], 0), (10, [1.0], 0), (None, [1.0, 0.0], 0), (4, [2.0, 2.0], 0)]
    got = search(spark, rows)
    assert set(got) == {0, 50}
    assert [a for a, _ in got[0]] == [3, 4, 50] and got[0][0][1] == got[0][1][1] == pytest.approx(0.5**0.5)
    assert search(spark, rows[4:6]) == {}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_copies_of_one_vector_are_dealt_into_cells(spark):
    x = clusters(400, 8, 1)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(1000 + k, x[50].tolist(), 0) for k in range(900)]
    got = search(spark, rows, settings=ann.Settings(cell=2, leaf=50))
    assert [a for a, _ in got[50]] == [1000, 1001, 1002, 1003, 1004]
    assert [a for a, _ in got[1000]] == [50, 1001, 1002, 1003, 1004]


def test_graph_links_hub_without_growth(spark):
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(edges).where("component = 0").count() == 3000
