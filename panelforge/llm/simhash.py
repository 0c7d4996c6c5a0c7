"""SimHash near-duplicates over anchor points of a covering code.

The anchors are words of the binary Golay code, one code for every 23 bits: each word of 23
bits lies within 3 bits of exactly one of the 4096 anchors, its home. Two fingerprints that
differ in few bits have homes close to both, so every fingerprint goes to all anchors within
the covering radius plus the threshold, and only fingerprints of one anchor are compared. Equal
fingerprints count once. What is found are star edges, no lists of pairs. A plan with a similarity
takes these edges as candidates only, and links texts by their sets of shingles.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, offsets, prepare, ragged, spread, texts_of, tidy
from .graph import components

BITS, RADIUS = 23, 3
SMALL = 7  # bits of a block of the Hamming code
_GENERATOR = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
# byte -> a machine word with bit k of the byte in byte k
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


@dataclass(frozen=True)
class Plan:
    """What a fingerprint is, and which links count.

    shingle: words of a shingle. words: machine words of a fingerprint. distance: bits that linked
    fingerprints differ in at most. tables: for each table, the bits of its blocks of 23 bits; a
    fingerprint goes to the anchors that changing ``reach`` bits in a table can lead to. Blocks of 7 bits give the home alone. similarity:
    if not 0, fingerprints are of sets of shingles and only candidates; links are pairs whose sets have
    this similarity (Jaccard) at least.
    """

    shingle: int = 3
    words: int = 1
    distance: int = 2
    tables: tuple = ((tuple(range(BITS)), tuple(range(BITS, 2 * BITS))),)
    reach: int = 2
    similarity: float = 0.0


#: Pairs that a fingerprint of unlike texts meets, at most, whatever the number of texts.
PAIRS = 1 << 16
#: Fingerprints of one anchor that a task holds.
LARGE = 1 << 18


def near_plan(texts: int = 0, shingle: int = 5, words: int = 10, distance: int = 136, loss: float = 0.002, seed: int = 11) -> Plan:
    """Links at a shingle similarity of 0.8 or more, among candidates of about that similarity.

    Sets of similarity J make vectors with cosine 2J/(1+J), and a bit differs with probability
    arccos(cosine)/pi: 0.151 at J = 0.8, so 97 of 640 bits on average, with a deviation of 9; the distance
    leaves four deviations. Each table has bits of its own choice and one home for each fingerprint: a block of 23 bits
    and, as ``texts`` grow, blocks of 7 bits (the Hamming code, whose 16 anchors lie within one bit of all words), so that unlike
    fingerprints meet in at most ``PAIRS`` pairs each. There are as many tables as a pair at J = 0.8 needs to share a home
    in one at least but for a share of ``loss``: 56 of one block, about twice as many with each small one.
    Replication over one bit takes fewer tables, but more rows for the same.
    """
    share, blocks = 1 - loss ** (1 / 56), 0
    tables = 56
    while tables * texts > PAIRS << 12 + 4 * blocks:
        blocks += 1
        tables = math.ceil(math.log(loss) / math.log1p(-share * _shared_home(0.151) ** blocks))
    rng = np.random.default_rng(seed)
    drawn = [np.split(rng.choice(64 * words, BITS + SMALL * blocks, replace=False), BITS + SMALL * np.arange(blocks)) for _ in range(tables)]
    return Plan(shingle, words, distance, tuple(tuple(tuple(sorted(b.tolist())) for b in table) for table in drawn), 0, 0.8)


@functools.cache
def _hamming() -> np.ndarray:
    """The home (4 bits) of each word of 7 bits: the code word within one bit of it."""
    word = np.arange(1 << SMALL)
    syndrome = np.bitwise_xor.reduce([(word >> b & 1) * (b + 1) for b in range(SMALL)])
    code = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
    return (code >> 2 & 1) | (code >> 4 & 1) << 1 | (code >> 5 & 1) << 2 | (code >> 6 & 1) << 3


def _shared_home(rate: float) -> float:
    """How often two words of 7 bits share a home, if each bit differs at this rate."""
    home, word = _hamming(), np.arange(1 << SMALL)
    change = np.bitwise_count(word).astype(np.int64)
    weight = rate**change * (1 - rate) ** (SMALL - change)
    return float(sum(w * (home == home[word ^ e]).mean() for e, w in zip(word, weight, strict=True)))


@functools.cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits of a word; the error of each syndrome."""
    words = np.append(np.arange(1 << 12), np.arange(1 << 11) << 12)
    for b in range(BITS - 1, 10, -1):
        words ^= ((words >> b) & 1) * (_GENERATOR << (b - 11))
    low, high = words[: 1 << 12], words[1 << 12 :]
    leader = np.zeros(2048, np.int64)
    for weight in range(RADIUS + 1):
        for bits in itertools.combinations(range(BITS), weight):
            error = sum(1 << b for b in bits)
            leader[low[error & 0xFFF] ^ high[error >> 12]] = error
    return low, high, leader


def nearest_anchor(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home (high 12 bits of its anchor) and the syndrome of words of 23 bits."""
    low, high, leader = _code()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words ^ leader[syndrome]) >> 11, syndrome


@functools.cache
def _reachable(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, the homes (to be XORed with the own one) that changing up to ``reach`` bits leads to and how many it takes: starts, homes, bits."""
    leader = _code()[2]
    best = np.full((2048, 4096), 99, np.int8)
    for weight in range(reach, -1, -1):
        for bits in itertools.combinations(range(BITS), weight):
            best[np.arange(2048), nearest_anchor(leader ^ sum(1 << b for b in bits))[0]] = weight
    rows, homes = np.nonzero(best <= reach)
    return np.searchsorted(rows, np.arange(2049)), homes.astype(np.int64), best[rows, homes]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash made from a 64-bit hash; the hash itself for k = 0."""
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes], shingle: int, seed: int = 42, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles one after the other, and how many each text has; ``once``: sorted, without repeats."""
    digest = xxhash.xxh64_digest
    parts, counts = [], []
    for t in texts:
        own = t.lower().split()  # ASCII: A-Z, and 0x20, 0x09 to 0x0D
        if len(own) < shingle:
            part = digest(b" ".join(own), seed) if own else b""
        else:
            joined = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            part = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: len(own) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
        if once:
            part = np.unique(np.frombuffer(part, ">u8").astype(np.uint64)).astype(">u8").tobytes()
        parts.append(part)
        counts.append(len(part) // 8)
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.array(counts, np.int64)


def fingerprints(texts: list[bytes], shingle: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """(texts, words) machine words: a bit is 1 if more than half of the shingles' hashes have it. No words: 0."""
    return _majority(*shingle_hashes(texts, shingle, seed), words)


def _majority(hashes: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(n), words), np.uint64)
    if not len(hashes):
        return out
    # Blocks of at most 255 hashes of one text: each lane of a machine word holds a count of up to 255.
    blocks = -(-n // 255)
    block_of = offsets(blocks)
    within = np.arange(int(block_of[-1])) - np.repeat(block_of[:-1], blocks)
    heads = np.repeat(offsets(n)[:-1], blocks) + within * 255
    full = np.flatnonzero(blocks)
    for k in range(words):
        lanes = _LANES[_mixed(hashes, k).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, heads, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.zeros((len(n), 64), np.int64)
        ones[full] = np.add.reduceat(sums.astype(np.int64), block_of[full], axis=0)
        out[:, k] = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def anchors(prints: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): the anchors that each fingerprint goes to; home marks its nearest one. An anchor's number holds its table."""
    starts, near, cost = _reachable(plan.reach)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    rows, ids, own = [], [], []
    for number, table in enumerate(plan.tables):
        row, key, left, at_home = np.arange(len(prints)), np.full(len(prints), number, np.int64), np.full(len(prints), plan.reach), np.ones(len(prints), bool)
        for block in table:
            if len(block) == SMALL:
                own_home = _hamming()[bits[:, list(block)].astype(np.int64) @ (1 << np.arange(SMALL))]
                key = key << 4 | own_home[row]
                continue
            word = bits[:, list(block)].astype(np.int64) @ (1 << np.arange(BITS))
            home, s = nearest_anchor(word)
            sizes = (starts[s + 1] - starts[s])[row]
            at = np.arange(int(sizes.sum())) - np.repeat(offsets(sizes)[:-1] - starts[s][row], sizes)
            row, key, left, at_home = (np.repeat(x, sizes) for x in (row, key, left, at_home))
            left = left - cost[at]
            key = key << 12 | (home[row] ^ near[at])
            stay = left >= 0
            at_home = at_home & (cost[at] == 0)
            row, key, left, at_home = row[stay], key[stay], left[stay], at_home[stay]
        rows.append(row)
        ids.append(key)
        own.append(at_home)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(own)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def links(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all rows within ``distance``, in a large group; no list of all pairs.

    All rows near a centre are linked to it. A row near one of these is within twice the distance of
    the centre, so only rows in between are compared with them, in blocks; then the near rows are done.
    """
    todo = np.arange(len(prints))
    while len(todo) > 1:
        d = _differ(prints[todo], prints[todo[0]])
        near, ring = todo[d <= distance], todo[(d > distance) & (d <= 2 * distance)]
        yield near[1:], np.full(len(near) - 1, near[0])
        for at in range(1, len(near), 256):
            if not len(ring):
                break
            block = near[at : at + 256]
            hit = np.zeros(len(ring), bool)
            for k in range(0, len(ring), 4096):
                part = ring[k : k + 4096]
                close = _differ(prints[part][:, None], prints[block][None]) <= distance
                hit[k : k + 4096] = found = close.any(axis=1)
                yield part[found], block[close[found].argmax(axis=1)]
            ring = ring[~hit]
        todo = todo[d > distance]


def _compare(anchor: np.ndarray, home: np.ndarray, prints: np.ndarray, distance: int, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked rows; rows come sorted by anchor. Small groups are compared by shifting, large ones around centres."""
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    sizes = np.diff(heads, append=len(anchor))
    size = np.repeat(sizes, sizes)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero((size > 1) & (size <= small))
    last = np.repeat(heads + sizes - 1, sizes)
    for shift in range(1, small):
        at = at[at + shift <= last[at]]
        if not len(at):
            break
        for k in range(0, len(at), 1 << 18):
            a = at[k : k + (1 << 18)]
            a = a[home[a] | home[a + shift]]
            a = a[_differ(prints[a], prints[a + shift]) <= distance]
            left.append(a)
            right.append(a + shift)
    for g in np.flatnonzero(sizes > small).tolist():
        for a, b in links(prints[heads[g] : heads[g] + sizes[g]], distance):
            left.append(a + heads[g])
            right.append(b + heads[g])
    return np.concatenate(left), np.concatenate(right)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) connect: one from each id but the smallest of a group to the smallest."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        for side in (left, right):
            np.minimum.at(fresh, label[side], low)
            np.minimum.at(fresh, side, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def fingerprint_column(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint of each whole text as bytes, the highest first. No words (null, empty): zero.

    With a similarity, 16 bytes follow that tell sets of shingles apart whose fingerprints are equal.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for ids, texts in chunks(batches):
            hashes, n = shingle_hashes(texts, plan.shingle, once=bool(plan.similarity))
            prints = [x.tobytes() for x in _majority(hashes, n, plan.words).astype(">u8")]
            if plan.similarity:
                at = offsets(n)
                prints = [x + xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for x, a, b in zip(prints, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "print"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(tidy(run), "doc_id long, print binary")


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(len(column), -1)[:, :words].astype(np.uint64)


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set, the place of the first one that it is connected with over pairs of a similarity of ``least`` or more.

    Every set is compared with all that nothing has reached yet: each set asks once, no pair that could connect two groups is left out.
    """
    n = np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    at, marked = offsets(n), np.zeros(len(values) + 1, np.int64)
    label, left, queue = np.full(len(sets), -1), np.arange(len(sets)), []
    while len(left):
        if not queue:
            label[left[0]] = left[0]
            queue.append(int(left[0]))
            left = left[1:]
            flat = np.append(ragged(codes, at[:-1][left], n[left]), len(values))
            heads = offsets(n[left])[:-1]
            continue
        c = queue.pop()
        own = codes[at[c] : at[c + 1]]
        marked[own] = 1
        both = np.where(n[left] > 0, np.add.reduceat(marked[flat], heads), 0)
        marked[own] = 0
        # x >= least * (a + b - x), without division; two empty sets are alike
        near = both + 1e-9 >= least * (n[left] + n[c] - both)
        if near.any():
            label[left[near]] = label[c]
            queue.extend(left[near].tolist())
            left = left[~near]
            flat = np.append(ragged(codes, at[:-1][left], n[left]), len(values))
            heads = offsets(n[left])[:-1]
    return label


def _groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which come one after the other."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        key = np.stack([t[k].to_numpy() for k in keys], axis=1)
        heads = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        if held and (key[0] != last).any():
            yield pa.concat_tables(held)
            held = []
        for x, y in zip(heads, [*heads[1:], None], strict=True):
            if y is None:
                held.append(t.slice(x))
            else:
                yield pa.concat_tables([*held, t.slice(x, y - x)])
                held = []
        last = key[-1]
    if held:
        yield pa.concat_tables(held)


def exact_components(docs: DataFrame, found: DataFrame, plan: Plan, part: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component): the groups of ``found`` parted by the similarity of whole sets of shingles.

    A group of up to ``part`` texts is compared in one place. A larger one is dealt into parts, each with the
    group's least text; texts connected with that one need no comparison among each other, and those that
    aren't meet all parts, again so many at a time.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("component", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    sized = found.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    texts = texts_of(docs, id_col, text_col).join(sized.withColumnRenamed("node", "doc_id"), "doc_id")
    fields = texts.select("component", "parts", "doc_id", "text")

    def reduce(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                piece = b.slice(k, 256)
                hashes, n = shingle_hashes(piece.column(3).to_pylist(), plan.shingle, once=True)
                at = offsets(n)
                sets = pa.array([hashes[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], sets], ["component", "parts", "node", "shingles"])

    # Rows may repeat an id: the texts of one id are all compared, and the id stands for each of them.
    sets = fields.mapInArrow(reduce, "component long, parts int, node long, shingles binary").distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).checkpoint()

    def compare(batches):
        for t in _groups(batches, ["component", "block", "part"]):
            node = t["node"].to_numpy()
            own = similar([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], plan.similarity)
            a, b = stars(node, node[own])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "component", "block", "part").sortWithinPartitions("component", "block", "part", "node").mapInArrow(compare, "a long, b long")

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    hubs = sets.where("parts > 1 and node = component").select("component", F.lit(0).alias("block"), every.alias("part"), "node", "shingles")
    first = compared(sets.select("component", F.lit(0).alias("block"), "part", "node", "shingles").union(hubs)).checkpoint()
    # Of large groups: texts not connected with the least one, and the blocks that they make.
    joined = first.select(F.col("a").alias("node"), F.col("b").alias("to"))
    apart = sets.where("parts > 1 and node <> component").join(joined, "node", "left").where("to is null or to <> component").drop("to")
    blocks = apart.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("blocks"))
    asking = apart.join(blocks, "component").select("component", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), every.alias("part"), "node", "shingles")
    asked = sets.where("parts > 1").join(blocks, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "node", "shingles")
    return components(first.union(compared(asking.union(asked))))


def crowded_links(rows: DataFrame, plan: Plan, large: int) -> DataFrame:
    """Edges (a, b) that connect all rows (anchor, rep, print) of an anchor within the plan's distance, for anchors too large for a task.

    Rows are dealt into parts of about ``large``, each with the anchor's least id. Rows connected with that one
    need no comparison among each other; those that aren't meet all parts, again so many at a time. No link is lost; of an anchor
    with g rows, u of them not connected with its least id, about g * u / ``large`` rows are dealt again.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / large).cast("int").alias("parts"), F.min(F.struct("rep", "print")).alias("hub"))
    dealt = rows.join(sizes.select("anchor", "parts", F.col("hub.rep").alias("least")), "anchor").withColumn("part", F.pmod(F.xxhash64("rep", "print"), F.col("parts")).cast("int"))

    def compare(batches):
        for t in _groups(batches, ["anchor", "block", "part"]):
            rep = t["rep"].to_numpy()
            found = list(links(_matrix(t["print"].combine_chunks(), plan.words), plan.distance))
            a, b = stars(*(rep[np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])] for k in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), t["anchor"][0].as_py(), np.int64)), pa.array(a), pa.array(b)], ["anchor", "a", "b"])

    def compared(some: DataFrame) -> DataFrame:
        return some.repartition(parts, "anchor", "block", "part").sortWithinPartitions("anchor", "block", "part", "rep").mapInArrow(compare, "anchor long, a long, b long")

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hubs = sizes.select("anchor", F.lit(0).alias("block"), every, "hub.rep", "hub.print")
    first = compared(dealt.select("anchor", F.lit(0).alias("block"), "part", "rep", "print").union(hubs)).checkpoint()
    joined = first.select("anchor", F.col("a").alias("rep"), F.col("b").alias("to")).distinct()
    # An id's rows lie in several parts if it is repeated: one that is connected with the least id speaks for all of them.
    done = joined.join(sizes.select("anchor", F.col("hub.rep").alias("to")), ["anchor", "to"], "left_semi").select("anchor", "rep").distinct()
    apart = dealt.where("rep <> least").join(done, ["anchor", "rep"], "left_anti")
    blocks = apart.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / large).cast("int").alias("blocks"))
    asking = apart.join(blocks, "anchor").select("anchor", F.pmod(F.xxhash64("print", "rep"), F.col("blocks")).cast("int").alias("block"), every, "rep", "print")
    asked = dealt.join(blocks, "anchor").select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "rep", "print")
    return first.select("a", "b").union(compared(asking.union(asked)).select("a", "b"))


def near_duplicates(docs: DataFrame, plan: Plan | None = Plan(), id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, print, component_id): the smallest id reachable over links, for every row.

    Texts without words (null, empty, blank) have the fingerprint zero and are linked like any other.
    Repeated rows and equal texts are one class from the start; their links are not expanded. An empty
    table gives no rows. Rows whose id is null are compared, but get no id themselves. Very long texts are taken whole;
    other columns, however named, are pruned. Without a plan, it is ``near_plan`` of as many texts as there are.
    A task holds about ``large`` fingerprints of an anchor; those of a larger one are passed on, unheld, and compared in parts (``crowded_links``).
    """
    prepare(docs.sparkSession)
    prints = fingerprint_column(docs, plan or near_plan(), id_col, text_col).checkpoint()
    plan = plan or near_plan(prints.count())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))

    def replicate(batches):
        for b in batches:
            rep, column = b.column(1).to_numpy(zero_copy_only=False), b.column(0)
            for k in range(0, len(rep), 4096):
                row, anchor, home = anchors(_matrix(column[k : k + 4096], plan.words), plan)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(rep[k : k + 4096][row]), column[k : k + 4096].take(pa.array(row))], ["anchor", "home", "rep", "print"])

    def compare(batches):
        held: list[pa.Table] = []
        size, streamed = 0, None

        def found(t: pa.Table) -> pa.RecordBatch:
            rep = t["rep"].to_numpy()
            a, b = _compare(t["anchor"].to_numpy(), t["home"].to_numpy(), _matrix(t["print"].combine_chunks(), plan.words), plan.distance)
            a, b = stars(rep[a], rep[b])
            none = [pa.nulls(len(a), t.schema.field(k).type) for k in ("anchor", "print")]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], ["a", "b", "anchor", "print"])

        def passed_on(t: pa.Table) -> list[pa.RecordBatch]:
            return pa.table({"a": t["rep"], "b": pa.nulls(t.num_rows, pa.int64()), "anchor": t["anchor"], "print": t["print"]}).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if streamed is not None:
                more = int(np.searchsorted(t["anchor"].to_numpy(), streamed, "right"))
                yield from passed_on(t.slice(0, more))
                t = t.slice(more)
                if not t.num_rows:
                    continue
                streamed = None
            anchor = t["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if cut or (held and held[-1]["anchor"][-1].as_py() != anchor[0]):
                whole = pa.concat_tables([*held, t.slice(0, cut)])
                held, size = [], 0
                if whole.num_rows > 1:
                    yield found(whole)
            held.append(t.slice(cut))
            size += t.num_rows - cut
            if size > large:
                yield from passed_on(pa.concat_tables(held))
                held, size, streamed = [], 0, anchor[-1]
        if held and (whole := pa.concat_tables(held)).num_rows > 1:
            yield found(whole)

    # A class is a few bytes and becomes dozens of rows: deal classes out before that.
    dealt = classes.where("rep is not null").select(F.substring("print", 1, 8 * plan.words).alias("print"), "rep").repartition(parts).mapInArrow(tidy(replicate), "anchor long, home boolean, rep long, print binary")
    met = dealt.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(compare), "a long, b long, anchor long, print binary").checkpoint()
    edges, crowded = met.where("anchor is null").select("a", "b"), met.where("anchor is not null").select("anchor", F.col("a").alias("rep"), "print")
    if not crowded.isEmpty():
        edges = edges.union(crowded_links(crowded, plan, large))
    found = components(edges)
    if plan.similarity:
        found = exact_components(docs, found, plan, id_col=id_col, text_col=text_col)
    known = classes.join(found, classes.rep == found.node, "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(known, "print").select("doc_id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its group, with all their columns.

    Rows without an id stay. Rows that repeat an id stay or go together; they stay if one of them is smallest. Texts without words
    (null, empty, blank) are one group. An empty table gives no rows; columns of any other name pass through.
    """
    found = near_duplicates(docs, plan, id_col, text_col).where("doc_id is not null")
    going = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first")).where("first = 0")
    return docs.join(going.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
