"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

The trees are fitted on a bounded sample and sent to all tasks; every row gets its leaf in each
tree and is dealt out once. A query walks all trees through one queue, the leaves behind the nearest hyperplanes first,
until they hold a share of the forest. The place of a row is the sum over all trees of
the cost at which its leaf was reached (for leaves never reached, the cost at which the walk ended), and the rows with
the least sums get exact scores: about ``candidates`` times the square root of all rows, at every size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import prepare, ragged


@dataclass(frozen=True)
class Settings:
    """trees; sample: rows that the trees are fitted on, at most; leaf: sample rows in a leaf, at most;
    share: part of the rows that the leaves reached in a tree hold, on average; candidates: rows scored for a query, in square roots
    of all rows; cover: part of the sample's candidates that the cells visited hold; cell: rows of one cell, in square roots of all rows;
    block: questions that one task puts to a cell, about."""

    trees: int = 32
    sample: int = 8192
    leaf: int = 20
    share: float = 0.8
    candidates: float = 4.0
    cover: float = 0.99
    cell: float = 4.0
    block: int = 65_536
    seed: int = 5


@dataclass
class Tree:
    """Inner nodes: a unit normal, a threshold, two children; a child of -1 - k is leaf k. sizes: sample rows in each leaf. levels: inner nodes by depth."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    sizes: np.ndarray
    levels: list[np.ndarray]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            at = node[todo]
            side = (x[todo] * self.normals[at]).sum(axis=1) > self.thresholds[at]
            node[todo] = self.children[at, side.astype(np.int64)]
            todo = todo[node[todo] >= 0]
        return -1 - node

    def costs(self, q: np.ndarray) -> np.ndarray:
        """(leaves, queries): the sum of the distances to the hyperplanes that lie between a query and a leaf."""
        inner = len(self.normals)
        cost = np.zeros((inner + len(self.sizes), len(q)))
        margin = self.normals @ q.T - self.thresholds[:, None]
        place = np.where(self.children >= 0, self.children, inner - 1 - self.children)
        for level in self.levels:
            m, own = margin[level], cost[level]
            cost[place[level, 0]] = own + np.maximum(m, 0)
            cost[place[level, 1]] = own + np.maximum(-m, 0)
        return cost[inner:]


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator, tries: int = 3) -> Tree:
    """Splits at the median of a projection: of some random directions, the one along which the rows spread most."""
    normals, thresholds, children, sizes, depths = [], [], [], [], []

    def add(rows: np.ndarray, depth: int) -> int:
        if len(rows) <= leaf:
            sizes.append(len(rows))
            return -len(sizes)
        directions = rng.standard_normal((tries, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        along = sample[rows] @ directions.T
        best = int(along.std(axis=0).argmax())
        cut = float(np.median(along[:, best]))
        right = along[:, best] > cut
        if not right.any() or right.all():  # copies of one vector
            sizes.append(len(rows))
            return -len(sizes)
        here = len(normals)
        normals.append(directions[best])
        thresholds.append(cut)
        depths.append(depth)
        children.append([0, 0])
        children[here] = [add(rows[~right], depth + 1), add(rows[right], depth + 1)]
        return here

    add(np.arange(len(sample)), 0)
    deep = np.array(depths, np.int64)
    levels = [np.flatnonzero(deep == d) for d in range(int(deep.max()) + 1)] if depths else []
    return Tree(np.array(normals, np.float64).reshape(-1, sample.shape[1]), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), np.array(sizes, np.int64), levels)


def walk(costs: list[np.ndarray], shares: list[np.ndarray], wanted: float) -> np.ndarray:
    """For each query, the cost at which one queue over all trees' leaves has handed out the share ``wanted`` of the forest.

    A cost never falls on the way down, so a queue of nodes would hand out leaves in the order of their costs;
    sorting the leaves of all trees gives that order.
    """
    cost, share = np.concatenate(costs).T, np.concatenate(shares) / len(shares)
    order = np.argsort(cost, axis=1)
    last = (np.cumsum(share[order], axis=1) < wanted).sum(axis=1).clip(max=cost.shape[1] - 1)
    return np.take_along_axis(cost, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]


def places(costs: list[np.ndarray], ends: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """(rows, queries): the sum over all trees of the costs of the rows' leaves, each at most the cost at which the walk ended."""
    out = np.zeros((len(leaves), len(ends)), np.float32)
    for t, cost in enumerate(costs):
        out += np.minimum(cost, ends).astype(np.float32).take(leaves[:, t], axis=0)
    return out


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as double-precision rows, and their places."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts, ends = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    right = np.flatnonzero((ends - starts == dim) & ~np.asarray(column.is_null()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    x = ragged(values, starts[right], np.full(len(right), dim)).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        square = (x * x).sum(axis=1)
    good = np.isfinite(x).all(axis=1) & np.isfinite(square) & (square > 0)
    return x[good], right[good]


def nearest(rows: DataFrame, every: int = 50, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored): each query's ``k`` nearest rows found, by cosine in double precision.

    Queries are the rows whose id is divisible by ``every``; a query's own id is no candidate of it. Ties go to the
    smaller id. n_scored: how many rows got an exact score for the query. Rows whose vector or id is null, whose vector is zero, holds a null or
    non-finite component or hasn't the usual length take no part. An empty table gives no rows. Rows that
    repeat an id and its vector count once. An id with several vectors is as near as its nearest one, and as a query asks with each. Other
    columns, however named, are pruned.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    exact = np.float32 if kind == "array<float>" else np.float64
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null")
    sample = own.orderBy(F.xxhash64("id"), "id").limit(settings.sample).toArrow()
    sized = np.bincount(sample["v"].combine_chunks().value_lengths().to_numpy()) if sample.num_rows else np.zeros(1, np.int64)
    dim = int(sized.argmax())
    x, _ = _vectors(sample["v"], dim) if dim else (np.zeros((0, 1)), None)
    rng = np.random.default_rng(settings.seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    trees = [grow(unit, settings.leaf, rng) for _ in range(settings.trees)]
    known = np.stack([t.leaves(unit) for t in trees], axis=1).astype(np.int16)
    forest = spark.sparkContext.broadcast((trees, known, dim))  # bounded by the sample

    def place(batches):
        trees, _, dim = forest.value
        for b in batches:
            x, at = _vectors(b.column(1), dim) if dim else (np.zeros((0, 1)), np.zeros(0, np.int64))
            if not len(at):
                continue
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            leaf = np.stack([t.leaves(unit) for t in trees], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[at]), pa.array(leaf[:, 0], pa.int32()), _bytes(leaf), _lists(x.astype(exact))], ["id", "home", "leaf", "v"])

    placed = own.dropDuplicates(["id", "v"]).mapInArrow(place, f"id long, home int, leaf binary, v {kind}").checkpoint()
    size = np.zeros(len(trees[0].sizes), np.int64)
    asking = 0
    for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("asking")).collect():
        size[r["home"]] = r["n"]
        asking += r["asking"]
    total = int(size.sum())
    root = math.sqrt(max(1, total))
    most = math.ceil(settings.cell * root)
    # Neighbouring leaves of the first tree make a cell of about ``most`` rows; a leaf with more (copies of a vector, say) is dealt into several.
    cell_of, parts_of = np.zeros(len(size), np.int64), []
    held = 0
    for leaf, n in enumerate(size.tolist()):
        if leaf and held + n > most:
            parts_of.append(max(1, -(-held // most)))
            held = 0
        cell_of[leaf] = len(parts_of)
        held += n
    parts_of = np.array([*parts_of, max(1, -(-held // most))])
    first_of = np.append(0, np.cumsum(parts_of))
    blocks = max(1, -(-asking // settings.block))
    scored = min(1.0, max(settings.candidates / root, 20 / settings.sample))  # the sample can't tell a smaller share

    def hashed(ids: np.ndarray, salt: int) -> np.ndarray:
        return ((ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    schema = f"cell long, asks boolean, id long, leaf binary, v {kind}, reached double, bound double"
    names = ["cell", "asks", "id", "leaf", "v", "reached", "bound"]

    def deal(batches):
        for b in batches:
            ids, cell = b.column(0).to_numpy(), cell_of[b.column(1).to_numpy()]
            key = (first_of[cell] + hashed(ids, 0) % parts_of[cell]) * blocks
            none = pa.nulls(len(ids), pa.float64())
            for block in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(key + block), pa.array(np.zeros(len(ids), bool)), b.column(0), b.column(2), b.column(3), none, none], names)

    def ask(batches):
        trees, known, _ = forest.value
        shares = [np.bincount(known[:, t], minlength=len(tree.sizes)) / max(1, len(known)) for t, tree in enumerate(trees)]
        wanted = min(len(known), max(1, math.ceil(scored * len(known))))
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(3)).astype(np.float64)
            for k0 in range(0, len(x), 64):
                q = x[k0 : k0 + 64] / np.linalg.norm(x[k0 : k0 + 64], axis=1, keepdims=True)
                costs = [t.costs(q) for t in trees]
                reached = walk(costs, shares, settings.share)
                near = places(costs, reached, known)
                bound = np.partition(near.T, wanted - 1, axis=1)[:, wanted - 1].astype(np.float64)
                row, key = [], []
                for k in range(len(q)):
                    inside = np.bincount(cell_of[known[near[:, k] <= bound[k], 0]], minlength=len(parts_of))
                    order = np.argsort(-inside, kind="stable")
                    n = int(np.searchsorted(np.cumsum(inside[order]), settings.cover * inside.sum())) + 1
                    cells = np.concatenate([np.arange(first_of[c], first_of[c + 1]) for c in order[:n].tolist()])
                    key.append(cells * blocks + int(hashed(ids[k0 + k : k0 + k + 1], 1)[0]) % blocks)
                    row.append(np.full(len(cells), k))
                at = np.concatenate(row)
                take = pa.array(at + k0)
                # Sums of costs may differ in their last bits from task to task.
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.ones(len(at), bool)), b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(reached[at]), pa.array((bound + 1e-4 * (1 + bound))[at])], names)

    questions = placed.where(F.col("id") % every == 0).mapInArrow(ask, schema)
    both = placed.mapInArrow(deal, schema).unionByName(questions)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def answer(batches):
        """A cell's rows come before its questions; rows are held, questions pass by."""
        trees, _, _ = forest.value
        now, held, own = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            heads = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1]))), len(cell)).tolist()
            for a, z in zip(heads[:-1], heads[1:], strict=True):
                if cell[a] != now:
                    now, held, own = cell[a], [], None
                if not asks[a]:
                    held.append(b.slice(a, z - a))
                elif held:
                    own = own or _cell(pa.Table.from_batches(held), len(trees))
                    for k0 in range(a, z, 256):
                        yield _answers(trees, *own, b.slice(k0, min(256, z - k0)), k)

    found = both.repartition(parts, "cell").sortWithinPartitions("cell", "asks").mapInArrow(answer, "query_id long, vec_id long, score double, n_scored long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("n_scored").alias("n_scored"))
    query = Window.partitionBy("query_id")
    ranked = best.withColumn("n_scored", F.sum("n_scored").over(query)).where("vec_id is not null")
    order = query.orderBy(F.desc("score"), "vec_id")
    return ranked.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score", "n_scored").where(F.col("rank") <= k)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(column: pa.ListArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cell(t: pa.Table, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, leaves, vectors and their lengths of a cell's rows."""
    v = _matrix(t["v"]).astype(np.float64)
    leaf = np.frombuffer(b"".join(t["leaf"].to_pylist()), np.int16).reshape(-1, trees)
    return t["id"].to_numpy(), leaf, v, np.sqrt((v * v).sum(axis=1))


def _answers(trees: list[Tree], ids: np.ndarray, leaf: np.ndarray, v: np.ndarray, norm: np.ndarray, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The best ``k`` ids of a cell for each question, and a row without id that tells how many rows were scored."""
    asking, x = asked.column(2).to_numpy(), _matrix(asked.column(4)).astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    near = places([t.costs(x / length[:, None]) for t in trees], asked.column(5).to_numpy(), leaf) <= asked.column(6).to_numpy()
    query, vec, score, n = [], [], [], []
    for j, q in enumerate(asking.tolist()):
        at = np.flatnonzero(near[:, j])
        at = at[ids[at] != q]
        if not len(at):
            continue
        own = (v[at] * x[j]).sum(axis=1) / (norm[at] * length[j])
        order = np.lexsort((ids[at], -own))
        _, once = np.unique(ids[at][order], return_index=True)  # of an id's vectors the nearest
        best = order[np.sort(once)[:k]]
        query.append(np.full(len(best) + 1, q))
        vec.append(np.append(ids[at][best], 0))
        score.append(np.append(own[best], np.nan))
        n.append(np.append(np.zeros(len(best), np.int64), len(at)))
    if not query:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], ["query_id", "vec_id", "score", "n_scored"])
    total = np.concatenate(n)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(vec), mask=total > 0), pa.array(np.concatenate(score), mask=total > 0), pa.array(total)], ["query_id", "vec_id", "score", "n_scored"])
