"""Rules for the register, and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.functions.missing import as_date, as_number, half_even, na_case, present


def positive_revenue(df: DataFrame, col: str = "revenue_last_year") -> DataFrame:
    """Negative values lose their sign."""
    return df.withColumn(col, na_case(F.col(col) < 0, F.abs(col), F.col(col)))


def plausible_year(df: DataFrame, as_of_year: int | None = None, first: int = 1900, col: str = "foundation_year") -> DataFrame:
    """Years before ``first`` or after ``as_of_year`` (the current one by default) become null."""
    last = F.lit(as_of_year) if as_of_year is not None else F.year(F.current_date())
    return df.withColumn(col, F.when((F.col(col) >= first) & (F.col(col) <= last), F.col(col)))


def group_median(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Missing values become the median of their group, unrounded; rows with a null key and groups without values keep null.

    Medians are aggregated from counts of values before rows are shuffled, and joined back, so a group
    with a large share of all rows isn't gathered in one task as a window would.
    """
    names = [f"_key_{k}" for k in keys]
    medians = df.where(F.col(col).isNotNull()).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.median(present(col)).alias("_median"))
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]
    joined = df.join(medians, on, "left")
    return joined.select(*(F.coalesce(F.col(c), F.col("_median")).alias(c) if c == col else F.col(c) for c in df.columns))


def interpolated(col: str, key: str | Sequence[str] = "firm_id", time: str = "month") -> Column:
    """Missing values on the line between their neighbours in time, by days; the nearest value before the first and after the last."""
    series = Window.partitionBy(*([key] if isinstance(key, str) else key))
    v = present(col)
    at = F.when(v.isNotNull(), F.col(time))
    # The next value is the last one before in reversed order: a second sort, but a step for each row however long a series is.
    orders = (F.col(time).asc_nulls_last(), F.col(time).desc_nulls_first())
    (pv, pt), (nv, nt) = ([F.last(x, ignorenulls=True).over(series.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for x in (v, at)] for o in orders)
    share = F.try_divide(F.datediff(F.col(time), pt).cast("double"), F.datediff(nt, pt).cast("double"))
    return F.when(v.isNotNull(), v).when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(pv + (nv - pv) * share)


def interpolate(df: DataFrame, col: str, round_imputed: bool = False, strict: bool = False, key: str = "firm_id", time: str = "month") -> DataFrame:
    """``col`` with gaps filled; imputed values rounded to even if asked for.

    A series with one value is filled with it, one with none stays missing; ``strict`` raises for a
    series that has a gap and fewer than two values.
    """
    filled = interpolated(col, key, time)
    value = F.when(present(col).isNull(), half_even(filled)).otherwise(F.col(col)) if round_imputed else filled
    if not strict:
        return df.withColumn(col, value)
    known = F.count(present(col)).over(Window.partitionBy(key))
    gap = present(col).isNull() & (known < 2)
    return df.withColumn(col, F.when(gap, F.raise_error(F.concat(F.lit("fewer than two values in series "), F.col(key).cast("string"))).cast("double")).otherwise(value))


def clean_register(df: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """All rules: signs, medians by sector and region, years."""
    return plausible_year(group_median(positive_revenue(df), "employees", ["nace_code", "region_code"]), as_of_year)


def clean_employment(df: DataFrame, strict: bool = False) -> DataFrame:
    return interpolate(df.withColumns({"month": as_date("month"), "employees": as_number("employees")}), "employees", True, strict)


def clean_turnover(df: DataFrame, strict: bool = False) -> DataFrame:
    return interpolate(df.withColumns({"month": as_date("month"), "turnover": as_number("turnover")}), "turnover", False, strict)
