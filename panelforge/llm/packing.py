"""Best-fit packing of token sequences under several capacities.

Pieces of equal length are alike, so a histogram of lengths decides everything: best fit
over at most ``capacity`` lengths yields a plan of ranges ("the next n pieces of this length go to
these bins, k in each, from this offset on"), whose size doesn't depend on the number of documents.
Pieces then get a rank among those of their length, and the plan turns the rank into a place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import bpe
from .bpe_columns import decoded
from .common import chunks, prepare, spread, texts_of, tidy


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds at most: tokens, documents, and the sum of squared lengths (attention cost).

    Documents and attention can bind only where they are less than ``tokens`` pieces of one token and the square of
    ``tokens``, as in ``TIGHT``.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


#: Long sequences of pieces of at most 1024 tokens, of few documents and of bounded attention cost: each of the three can bind.
TIGHT = Capacities(4096, 16, 3 * 1024 * 1024)


def plan(counts: dict[int, int], limits: Capacities, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, number of pieces, first bin, pieces in each bin, offset), by length and rank.

    Lengths go from the longest down. Each takes the open bins that score best among those with room
    under every capacity: ``norm`` takes the least weighted norm of what would be left, as shares of the
    capacities; ``dot`` the largest weighted product of the demand and what is left now. Open bins are
    kept as runs of bins of equal state, so a step handles a run at once.
    """
    total = np.array([limits.tokens, limits.documents, limits.attention], np.float64)
    w = np.array(weights)
    state = np.zeros((0, 5), np.int64)  # first bin, bins, tokens used, documents, attention used
    made: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > total).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            room = total.astype(np.int64) - state[:, 2:]
            each = (room // need).min(axis=1)
            fits = np.flatnonzero(each > 0)
            if len(fits):
                share = room[fits] / total
                score = (w * ((room[fits] - need) / total) ** 2).sum(axis=1) if rule == "norm" else -(w * share * (need / total)).sum(axis=1)
                at = int(fits[np.argmin(score)])
                first, n, used, docs, cost = state[at].tolist()
                k = int(each[at])
                state = np.delete(state, at, axis=0)
            else:
                k = int((total.astype(np.int64) // need).min())
                n = -(-left // k)
                first, used, docs, cost = bins, 0, 0, 0
                bins += n
            full = min(n, left // k)
            rest = min(left - full * k, k - 1) if full < n else 0
            runs = []
            if full:
                made.append((length, rank, full * k, first, k, used))
                runs.append((first, full, used + k * length, docs + k, cost + k * length * length))
            if rest:
                made.append((length, rank + full * k, rest, first + full, rest, used))
                runs.append((first + full, 1, used + rest * length, docs + rest, cost + rest * length * length))
            if n > full + (rest > 0):
                runs.append((first + full + (rest > 0), n - full - (rest > 0), used, docs, cost))
            state = np.concatenate([state, np.array([r for r in runs if r[2] < limits.tokens], np.int64).reshape(-1, 5)])
            rank += full * k + rest
            left -= full * k + rest
    return np.array(sorted(made), np.int64).reshape(-1, 6)


def pieces_of(docs: DataFrame, path: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and ``end_id``, cut where longer than ``limit``.

    All pieces but the first are of ``limit`` tokens. A null or empty text is the end id alone.
    """

    def run(batches):
        encoder = bpe.from_json_file(path)
        for ids, texts in chunks(batches):
            flat, first = encoder.encode(decoded(texts))
            rows = []
            bounds = first.tolist()
            end = np.array([end_id], "<u4").tobytes()
            data = flat.tobytes()
            for doc, a, b in zip(ids, bounds, bounds[1:], strict=False):
                whole, n = data[4 * a : 4 * b] + end, b - a + 1
                cuts = [0, *range(n % limit or limit, n + 1, limit)]
                rows += [(doc, k, s, e - s, zlib.crc32(whole[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``: from 0 without gaps among the pieces of a length, in no meaningful order.

    A length that a third of all pieces have is counted in ``buckets`` parts, so no task has it whole.
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    keys = ["length", "bucket"]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy(*keys).orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(base, keys).withColumn("rank", F.col("base") + F.col("own")).drop("bucket", "base", "own")


def best_fit(docs: DataFrame, path: str, end_id: int = 2, limits: Capacities = Capacities(), rule: str = "norm", longest: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Documents of more than ``longest`` tokens (a whole sequence, if not given) are cut. Sequences hold at most what ``limits`` say and have no gaps. Null or empty texts are one piece of one
    token; a very long text is cut into many pieces; repeated rows are packed each. An empty table gives
    no rows. The histogram of lengths (``limits.tokens`` rows at most) is all that the driver collects.
    """
    prepare(docs.sparkSession)
    pieces = pieces_of(docs, path, end_id, longest or limits.tokens, id_col, text_col).checkpoint()
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, limits, rule=rule)
    stride = 1 << 44

    def place(batches):
        keys = rows[:, 0] * stride + rows[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = rows[np.searchsorted(keys, length * stride + rank, "right") - 1]
            t = rank - r[:, 1]
            sequence, offset = r[:, 3] + t // r[:, 4], r[:, 5] + t % r[:, 4] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(pieces, buckets).select(*order).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
