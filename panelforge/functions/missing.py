"""Missing values: null and NaN are both missing, division follows IEEE 754, nothing raises.

Spark's own aggregates skip nulls but not NaN, its comparisons put NaN above every number, and
division by zero raises; the expressions here are the one place where that is settled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c: Column | str) -> Column:
    """The value as a double; null where text is no number."""
    return _col(c).try_cast("double")


def as_date(c: Column | str) -> Column:
    """The value as a date; null where text is no date."""
    return _col(c).try_cast("date")


def present(c: Column | str) -> Column:
    """The value as a double, null where it is null or NaN, or text that is no number."""
    x = as_number(c)
    return F.when(~F.isnan(x), x)


def ieee_divide(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom; by zero: infinite with the sign of top, NaN for 0 / 0. Null if either is null."""
    t, b = _col(top).cast("double"), _col(bottom).cast("double")
    by_zero = F.when(t > 0, F.when(F.isnan(t), F.lit(NAN)).otherwise(F.lit(INF))).when(t < 0, F.lit(-INF)).when(t == 0, F.lit(NAN))
    return F.when(b != 0, F.try_divide(t, b)).when(b == 0, by_zero)


def na_sum(c: Column | str) -> Column:
    """Sum of what is present; 0 of nothing."""
    return F.coalesce(F.sum(present(c)), F.lit(0.0))


def na_mean(c: Column | str, empty_nan: bool = False) -> Column:
    """Mean of what is present; of nothing, null or (``empty_nan``) NaN."""
    mean = F.avg(present(c))
    return F.coalesce(mean, F.lit(NAN)) if empty_nan else mean


def na_n_distinct(c: Column | str) -> Column:
    """Number of distinct values, null being one of them."""
    return F.count_distinct(_col(c)) + F.coalesce(F.bool_or(_col(c).isNull()), F.lit(False)).cast("long")


def na_any(condition: Column) -> Column:
    """Whether the condition holds for any row; false for none and where it is null throughout."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def na_case(condition: Column, yes: Column, no: Column) -> Column:
    """yes or no by the condition; null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def less(c: Column | str, bound) -> Column:
    """c < bound; never for NaN."""
    return (_col(c) < bound) & ~F.isnan(_col(c).cast("double"))


def greater(c: Column | str, bound) -> Column:
    """c > bound; never for NaN."""
    return (_col(c) > bound) & ~F.isnan(_col(c).cast("double"))


def at_least(bound, c: Column | str) -> Column:
    """The larger of both; null stays null."""
    x = _col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(bound), x))


def half_even(c: Column | str) -> Column:
    """Rounded to a whole number, ties to the even one."""
    return F.bround(_col(c), 0)


def pairwise_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation of the rows that have both values; null where one is constant or there are no such rows."""
    x, y = present(a), present(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def order_statistics(df: DataFrame, c: str, ranks: Sequence[int], bins: int = 1024) -> dict[int, float]:
    """The values at these places (from 0) of the sorted column, without sorting it. The column has no missing values.

    Each pass counts the values of the intervals that hold a wanted place in ``bins`` parts; the parts that hold one are the
    next intervals, until each is one value. A pass brings at most a part's least value, greatest value
    and number for each of ``bins`` parts of an interval to the driver, and there is at most an interval for each place.
    """
    x = F.col(c)
    low, high = df.agg(F.min(x), F.max(x)).first()
    found: dict[int, float] = {}
    todo = [(low, high, 0, sorted(set(ranks)))] if low is not None else []
    wide = True
    while todo:
        for lo, _, _, own in [t for t in todo if t[0] == t[1]]:
            found |= dict.fromkeys(own, lo)
        todo = [t for t in todo if t[0] != t[1]]
        if not todo:
            break
        part, number = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(todo):
            inside = (x >= lo) & (x <= hi)
            # Both scales never fall where x rises, and put the ends into different parts.
            scaled = wide or not math.isfinite(hi - lo)
            y, a, b = (_gentle(x), _gentle_value(lo), _gentle_value(hi)) if scaled else (x, lo, hi)
            if not a < b:
                y, a, b = F.when(x > lo, 1.0).otherwise(0.0), 0.0, 1.0
            place = F.least(F.greatest(F.floor((y - F.lit(a)) / F.lit(b - a) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
            number, part = F.when(inside, F.lit(k)).otherwise(number), F.when(inside, place).otherwise(part)
        rows = df.select(number.alias("number"), part.alias("part"), x.alias("x")).where("number is not null").groupBy("number", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        fresh = []
        for k, (_, _, base, own) in enumerate(todo):
            for r in sorted((r for r in rows if r["number"] == k), key=lambda r: r["part"]):
                here = [i for i in own if base <= i < base + r["n"]]
                if here:
                    fresh.append((r["lo"], r["hi"], base, here))
                base += r["n"]
        todo, wide = fresh, False
    return found


def _gentle(x: Column) -> Column:
    """Logarithmic on both sides of zero; infinite values get an end of their own."""
    y = F.signum(x) * F.log1p(F.abs(x))
    return F.least(F.greatest(y, F.lit(-1000.0)), F.lit(1000.0))


def _gentle_value(x: float) -> float:
    return max(-1000.0, min(1000.0, math.copysign(math.log1p(abs(x)), x)))


def six_number_summary(df: DataFrame, c: str) -> DataFrame:
    """One row: min, q1, median, mean, q3, max of what is present (quartiles between order statistics), and the number missing.

    The column is kept while the passes over it run; no task ever holds more than a batch of it.
    """
    spark = df.sparkSession
    kept = df.select(present(c).alias("x")).persist()
    try:
        row = kept.agg(F.avg("x").alias("mean"), F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing")).first()
        n, shares = row["n"], (0.0, 0.25, 0.5, 0.75, 1.0)
        places = [(math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in shares] if n else []
        values = order_statistics(kept.where("x is not null"), "x", [k for p in places for k in p])
    finally:
        kept.unpersist()
    at = [_between(values[a], values[b], q * (n - 1) - a) for (a, b), q in zip(places, shares, strict=False)] or [None] * 5
    return spark.createDataFrame([(at[0], at[1], at[2], row["mean"], at[3], at[4], row["n_missing"])], "min double, q1 double, median double, mean double, q3 double, max double, n_missing long")


def _between(a: float, b: float, share: float) -> float:
    return a if a == b or not share else a * (1 - share) + b * share


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b lacks; null equals null."""
    return a.select(*keys).subtract(b.select(*keys))
