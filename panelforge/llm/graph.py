"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SALTS = 16  # parts that the neighbours of one node are dealt into


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of edges (a, b): the component is its smallest node; nodes are those of the edges.

    Alternating large and small stars: each node hands its neighbours its least neighbour, until every
    edge points to the least node. The number of edges never grows, hubs are aggregated before they
    are shuffled, and every round is written to the checkpoint folder. Loops and repeats don't matter.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # A hub may have most edges: its neighbours meet its least one in SALTS parts.
        dealt = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = dealt.join(spread, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = small.where("a <> b").distinct().checkpoint()
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
