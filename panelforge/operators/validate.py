"""Checks of the data: one row each in a report, nothing raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.missing import greater, less, na_any, na_n_distinct, pairwise_corr, set_difference
from panelforge.operators.panel import left_join


def _row(check: str, table: str, df: DataFrame, violations, detail=None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table"), violations.cast("long").alias("n_violations"), (detail if detail is not None else F.lit(None)).cast("double").alias("detail"))


def unique_keys(df: DataFrame, key: str = "firm_id", table: str = "firms") -> DataFrame:
    """Rows beyond the number of distinct keys."""
    return _row("unique_keys", table, df.agg(F.count(F.lit(1)).alias("n"), na_n_distinct(key).alias("d")), F.col("n") - F.col("d"))


def orphan_ids(df: DataFrame, register: DataFrame, key: str = "firm_id", table: str = "employment") -> DataFrame:
    """Distinct keys that the register lacks."""
    return _row("orphan_ids", table, set_difference(df, register, [key]).agg(F.count(F.lit(1)).alias("n")), F.col("n"))


def employment_below_one(df: DataFrame, col: str = "employees", table: str = "employment") -> DataFrame:
    return _row("employment_below_one", table, df.agg(F.count_if(less(col, 1)).alias("n")), F.col("n"))


def correlation(employment: DataFrame, turnover: DataFrame) -> DataFrame:
    """Correlation of employees and turnover by firm and month; a violation if it isn't positive."""
    both = left_join(employment.select("firm_id", "month", "employees"), turnover.select("firm_id", "month", "turnover"), ["firm_id", "month"])
    row = both.agg(pairwise_corr("employees", "turnover").alias("r"))
    return _row("correlation", "employment", row, F.coalesce(F.col("r") <= 0, F.lit(False)), F.col("r"))


def productivity_range(panel: DataFrame, high: float = 1e7) -> DataFrame:
    """Productivity below 0 or above the bound; NaN isn't counted."""
    return _row("productivity_range", "panel", panel.agg(F.count_if(less("productivity", 0) | greater("productivity", high)).alias("n")), F.col("n"))


def any_nonpositive(panel: DataFrame, col: str = "employees_monthly") -> DataFrame:
    return _row("any_nonpositive", "panel", panel.agg(na_any(F.col(col) <= 0).alias("b")), F.col("b").cast("int"))


def short_series(df: DataFrame, col: str, table: str) -> DataFrame:
    """Firms with a gap and fewer than two values, which interpolation can't draw a line through."""
    per_firm = df.groupBy("firm_id").agg(F.count(col).alias("known"), F.count(F.lit(1)).alias("n"))
    return _row("short_series", table, per_firm.agg(F.count_if((F.col("known") < 2) & (F.col("known") < F.col("n"))).alias("n")), F.col("n"))


def panel_checks(panel: DataFrame, high: float = 1e7, below: bool = False) -> DataFrame:
    """Correlation, productivity range, non-positive employment and (``below``) employment below one in one pass: the panel holds the joined columns already."""
    row = panel.agg(
        F.count_if(less("employees_monthly", 1)).alias("below"),
        pairwise_corr("employees_monthly", "turnover_monthly").alias("r"),
        F.count_if(less("productivity", 0) | greater("productivity", high)).alias("n"),
        na_any(F.col("employees_monthly") <= 0).alias("b"),
    )
    none = F.lit(None).cast("double")
    found = [
        ("correlation", "employment", F.coalesce(F.col("r") <= 0, F.lit(False)).cast("long"), F.col("r")),
        ("productivity_range", "panel", F.col("n"), none),
        ("any_nonpositive", "panel", F.col("b").cast("long"), none),
    ]
    if below:
        found.append(("employment_below_one", "employment", F.col("below"), none))
    structs = [F.struct(F.lit(c).alias("check"), F.lit(t).alias("table"), n.alias("n_violations"), d.alias("detail")) for c, t, n, d in found]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def report(register: DataFrame, employment: DataFrame, turnover: DataFrame, panel: DataFrame, one_row_a_month: bool = False) -> DataFrame:
    """All checks in one table; each input is read once for each kind of check.

    one_row_a_month: the panel has each row of ``employment`` once, since no table repeats a key (``fused_panel`` sees to that for
    the monthly ones). Then employment below one is counted in the panel, and ``employment`` needn't be cleaned.
    """
    rows = [
        unique_keys(register),
        orphan_ids(employment, register),
        orphan_ids(turnover, register, table="turnover"),
        panel_checks(panel, below=one_row_a_month),
    ]
    if not one_row_a_month:
        rows.append(employment_below_one(employment))
    return reduce(DataFrame.unionByName, rows)
