"""Quality classifier: a linear support vector machine over n-gram indicators scaled by class log-count ratios.

Indicators are hashed word unigrams and bigrams, unigrams and bigrams of word shapes (case,
marks, whether the word repeats the one before or an earlier one), and steps of the shares
of such words. They are scaled by naive Bayes log-count ratios, brought to length one, and fitted
with hinge loss by dual coordinate descent; a logistic curve turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, offsets, prepare, spread, texts_of
from .repeats import _mix, word_hashes, word_spans

BINS = 1 << 18  # for hashed word n-grams
SHAPES = 64
STEPS = 16
SHARES = 8
#: Places of features: bigrams of shapes, unigrams of shapes, share steps, size steps, hashed n-grams.
_UNI, _STEP = SHAPES * SHAPES, SHAPES * SHAPES + SHAPES
_SIZE = _STEP + SHARES * (STEPS + 1)
_HASH = _SIZE + 64
FEATURES = _HASH + BINS

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, np.int8) for _ in range(4))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = 1
_LOWER[0x80:] = 1  # letters beyond ASCII count as lower case
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 1


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that the model is fitted on, at most, and size: bytes of their features; they are those with the least hash of their id."""

    sample: int = 6000
    size: int = 256 << 20
    penalty: float = 1.0
    epochs: int = 20
    smoothing: float = 1.0
    seed: int = 7


@dataclass
class Model:
    """weights: of each feature, times its log-count ratio; ratios: the ratios; a, b: the logistic curve of the margin."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    a: float
    b: float


def _counts(flags: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags[data], dtype=np.int32))
    return sums[ends] - sums[starts]


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every feature that a text has, each once, sorted."""
    data = b"\n".join(texts)
    starts, lengths = word_spans(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.append(offsets(sizes)[:-1] + np.arange(len(texts)), len(data) + 1))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    size_step = np.minimum(63, np.ceil(np.log2(n + 1) * 2).astype(np.int64))
    keys = [np.arange(len(texts)) * FEATURES + _SIZE + size_step]
    if len(starts):
        raw = np.frombuffer(data, np.uint8)
        ends = starts + lengths
        upper, lower, digit, mark = (_counts(f, raw, starts, ends) for f in (_UPPER, _LOWER, _DIGIT, _MARK))
        h = word_hashes(data, starts, lengths)
        same_doc = np.append(False, doc[1:] == doc[:-1])
        again = same_doc & np.append(False, h[1:] == h[:-1])
        order = np.lexsort((h, doc))
        before = np.zeros(len(h), bool)  # occurs more than once in its text, and not here for the first time
        before[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        shouts, bare = (upper > 0) & (lower == 0), (upper + lower + digit) == 0
        marked = (mark > 0) & ~bare
        shape = again + 2 * shouts + 4 * bare + 8 * marked + 16 * (digit > 0) + 32 * (lengths > 30)
        line = np.append(0, np.cumsum(raw == 0x0A, dtype=np.int32))[starts]
        heads = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | ~same_doc[1:]))
        line_hash = np.add.reduceat(_mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(heads, np.diff(heads, append=len(h))).astype(np.uint64)), heads)
        line_doc = doc[heads]
        by_line = np.lexsort((line_hash, line_doc))
        repeated = np.zeros(len(heads), bool)
        repeated[by_line[1:]] = (line_hash[by_line][1:] == line_hash[by_line][:-1]) & (line_doc[by_line][1:] == line_doc[by_line][:-1])
        some = np.maximum(n, 1)
        lines = np.maximum(np.bincount(line_doc, minlength=len(texts)), 1)
        shares = [np.bincount(doc, weights=x, minlength=len(texts)) / some for x in (again, before, shouts, bare, marked, digit > 0, lengths > 30)]
        shares.append(np.bincount(line_doc, weights=repeated, minlength=len(texts)) / lines)
        for k, share in enumerate(shares):
            step = np.floor(share * STEPS).astype(np.int64)
            for s in range(1, STEPS + 1):
                keys.append(np.flatnonzero(step >= s) * FEATURES + _STEP + k * (STEPS + 1) + s)
        keys.append(doc * FEATURES + _UNI + shape)
        inner = np.flatnonzero(same_doc)
        keys.append(doc[inner] * FEATURES + shape[inner - 1] * SHAPES + shape[inner])
        keys.append(doc * FEATURES + _HASH + (h % np.uint64(BINS)).astype(np.int64))
        pair = _mix(h[inner - 1] * np.uint64(3) + h[inner])
        keys.append(doc[inner] * FEATURES + _HASH + (pair % np.uint64(BINS)).astype(np.int64))
    found = np.sort(np.concatenate(keys))
    found = found[np.append(True, found[1:] != found[:-1])]
    return found // FEATURES, found % FEATURES


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, features: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine with hinge loss, by dual coordinate descent over rows in random order."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(features), 0.0, np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        widest = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, x = rows[i], values[i]
            gradient = y[i] * (float(w[at] @ x) + bias) - 1.0
            fresh = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            change = (fresh - alpha[i]) * y[i]
            if change:
                alpha[i] = fresh
                w[at] += change * x
                bias += change
                widest = max(widest, abs(change))
        if widest < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps, with targets drawn in by the class sizes."""
    up, down = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows with 0 are held out. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fitted on at most ``settings.sample`` labelled rows that aren't held out.

    Labels that are null are left out; a document labelled twice takes the smaller label. Without two
    classes the model scores all alike, by the one class there is (0.5 without any).
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(fold("doc_id") != 0).groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    chosen = dict(sample.select("doc_id", "y").toPandas().itertuples(index=False, name=None))
    few = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": list(chosen)}, dtype="int64"), "doc_id long")

    def run(batches):
        for ids, texts in chunks(batches):
            at, feature = indicators(texts)
            bounds = np.searchsorted(at, np.arange(len(texts) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["doc_id", "features"])

    # At most settings.sample rows, known from the limit above, of at most settings.size bytes; an id comes once, with the lesser of its texts' features.
    own = texts_of(docs, id_col, text_col).join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(run, "doc_id long, features binary")
    once = own.groupBy("doc_id").agg(F.min("features").alias("features"))
    held = F.sum(F.length("features")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = once.withColumn("held", held).where(F.col("held") <= settings.size).select("doc_id", "features").toPandas()
    found = found.sort_values("doc_id") if len(found) else found
    rows = [np.frombuffer(b, np.int32) for b in found["features"]]
    y = np.array([1.0 if chosen[d] else -1.0 for d in found["doc_id"]])
    ratios, weights = np.zeros(FEATURES), np.zeros(FEATURES)
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(weights, ratios, 0.0, 0.0, 0.0 if not len(y) else 5.0 * y[0])
    up, down = (np.bincount(np.concatenate([r for r, s in zip(rows, y, strict=True) if s == side]), minlength=FEATURES) + settings.smoothing for side in (1.0, -1.0))
    ratios = np.log(up / up.sum()) - np.log(down / down.sum())
    values = [_unit(ratios[r]) for r in rows]
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * settings.penalty
    w, bias = descend(rows, values, y, cost, FEATURES, settings.epochs, settings.seed)
    margins = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    a, b = _logistic(margins, y)
    return Model(w * ratios, ratios, bias, a, b)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _scores(texts: list[bytes], weights: np.ndarray, squares: np.ndarray, bias: float, a: float, b: float) -> np.ndarray:
    at, feature = indicators(texts)
    total = np.bincount(at, weights=weights[feature], minlength=len(texts))
    length = np.sqrt(np.bincount(at, weights=squares[feature], minlength=len(texts)))
    return 1 / (1 + np.exp(-np.clip(a * (total / np.maximum(length, 1e-12) + bias) + b, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, however long; null texts are empty, equal texts score alike.

    Repeated rows are scored each; a null id is held out; an empty table gives no rows; other columns are pruned.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratios**2, model.bias, model.a, model.b))  # FEATURES numbers each

    def run(batches):
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_scores(texts, *shared.value))], ["doc_id", "score"])

    scored = spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, with all their columns, of whatever name; texts stay where they are.

    Null texts count as empty; of repeated rows all stay or all go; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratios**2, model.bias, model.a, model.b))

    def run(batches):
        for b in batches:
            keep = []
            column = b.column(b.schema.get_field_index(text_col))
            if not b.num_rows:
                continue
            one = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), column.fill_null("").cast(pa.binary())], ["doc_id", "text"])
            keep += [_scores(texts, *shared.value) >= threshold for _, texts in chunks(iter([one]))]
            yield b.filter(pa.array(np.concatenate(keep)))

    return spread(docs).mapInArrow(run, docs.schema)
