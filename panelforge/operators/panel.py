"""The firm by month panel and its indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.functions.missing import as_date, as_number, half_even, ieee_divide, present
from panelforge.operators.clean import interpolated


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key matches a null key; the keys come once, all matches are kept.

    Columns on both sides that aren't keys get ``_x`` and ``_y``.
    """
    both = set(left.columns) & set(right.columns) - set(keys)
    a = left.select(*(F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(f"_right_{c}" if c in keys else f"{c}_y" if c in both else c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return a.join(b, on, "left").drop(*(f"_right_{k}" for k in keys))


def month_grid(firms: DataFrame, span: DataFrame | tuple[str, str], key: str = "firm_id", unique: bool = False) -> DataFrame:
    """(firm, month) for every firm and month of the span; the months are made within rows. ``unique``: no firm occurs twice.

    span: first and last month as text, or one row (first, last), which goes to all tasks. A span without a first month has no rows.
    """
    keys = firms.select(key) if unique else firms.select(key).distinct()
    if isinstance(span, DataFrame):
        both = keys.crossJoin(F.broadcast(span.where("first is not null")))
    else:
        both = keys.select(key, *(F.lit(x).cast("date").alias(n) for n, x in zip(("first", "last"), span, strict=True)))
    return both.select(key, F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))


def build_panel(employment: DataFrame, turnover: DataFrame, register: DataFrame) -> DataFrame:
    """Employment with turnover of the same firm and month, and the firm's register entry."""
    e = employment.withColumnRenamed("employees", "employees_monthly").drop("nace_code", "region_code")
    t = turnover.withColumnRenamed("turnover", "turnover_monthly").drop("nace_code", "region_code")
    r = register.withColumnRenamed("employees", "employees_firm")
    panel = left_join(left_join(e, t, ["firm_id", "month"]), r, ["firm_id"])
    return panel.withColumns({"month": as_date("month"), "employees_monthly": as_number("employees_monthly"), "turnover_monthly": as_number("turnover_monthly")})


def derive_indicators(panel: DataFrame, firm_keys: tuple[str, ...] = ("firm_id",)) -> DataFrame:
    """Growth on the same month a year ago and on the last month (by rows of the firm), productivity, and turnover relative to the firm's mean.

    All windows share one partitioning and one sort. On a panel with gaps, complete the grid first.
    """
    w = Window.partitionBy(*firm_keys).orderBy(F.col("month").asc_nulls_last())
    firm = Window.partitionBy(*firm_keys)
    t, e = F.col("turnover_monthly"), F.col("employees_monthly")
    lags = panel.withColumns({"_t12": F.lag(t, 12).over(w), "_e1": F.lag(e, 1).over(w), "_mean": F.avg(present(t)).over(firm)})
    made = {
        "turnover_yoy": ieee_divide(t - F.col("_t12"), F.col("_t12")),
        "emp_growth": ieee_divide(e - F.col("_e1"), F.col("_e1")),
        "productivity": ieee_divide(t, e),
        "month_num": F.month("month"),
        "seasonal_index": ieee_divide(t, F.col("_mean")),
    }
    return lags.withColumns(made).drop("_t12", "_e1", "_mean")


def fused_panel(employment: DataFrame, turnover: DataFrame, register: DataFrame) -> DataFrame:
    """Imputation, both joins and all indicators, with one exchange of the monthly rows.

    Rows of the two monthly tables are put under each other, dealt by firm and merged by month; all windows and
    the join with the register keep to that partitioning and its order. A firm is told by its id and whether that is null, so
    that null ids meet. Gives what cleaning, ``build_panel`` and ``derive_indicators`` give one after the
    other. A firm and month that a monthly table repeats raises an error: matches would multiply, which only those three do.
    """
    rest = [c for c in employment.columns if c not in ("firm_id", "month", "employees", "nace_code", "region_code", "month_num")]
    kind = employment.schema["firm_id"].dataType
    some = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    firm = ("_firm", "_no_firm")

    def keyed(df: DataFrame) -> list:
        return [F.coalesce(F.col("firm_id").cast(kind), some).alias(firm[0]), F.col("firm_id").isNull().alias(firm[1])]

    day, none = as_date("month").alias("month"), F.lit(None)
    e = employment.select(*keyed(employment), day, as_number("employees").alias("e"), none.cast("double").alias("t"), *rest, F.lit(1).alias("_in_e"), F.lit(0).alias("_in_t"))
    t = turnover.select(*keyed(turnover), day, none.cast("double").alias("e"), as_number("turnover").alias("t"), *(none.cast(employment.schema[c].dataType).alias(c) for c in rest), F.lit(0).alias("_in_e"), F.lit(1).alias("_in_t"))
    counted = e.unionByName(t).repartition(*firm).groupBy(*firm, "month").agg(*(F.max(c).alias(c) for c in ("e", "t", *rest)), *(F.sum(c).alias(c) for c in ("_in_e", "_in_t")))
    once = F.when(F.greatest("_in_e", "_in_t") > 1, F.raise_error(F.concat(F.lit("repeated firm and month: "), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (firm[0], "month")))).cast("boolean"))
    merged = counted.withColumns({"_in_t": F.coalesce(once, F.col("_in_t") > 0), "_in_e": F.coalesce(once, F.col("_in_e") > 0)})
    e_filled = F.when(present("e").isNull(), half_even(interpolated("e", firm))).otherwise(F.col("e"))
    t_filled = F.when(F.col("_in_t"), interpolated("t", firm))  # without a row in the table there is nothing to fill
    filled = merged.select(*firm, "month", *rest, e_filled.alias("employees_monthly"), t_filled.alias("turnover_monthly"), "_in_e").where("_in_e")
    r = register.withColumnRenamed("employees", "employees_firm")
    entries = r.select(*keyed(r), *(c for c in r.columns if c != "firm_id"))
    made = derive_indicators(filled.drop("_in_e"), firm).join(entries, list(firm), "left")
    before = ["month", *rest, "employees_monthly", "turnover_monthly", *(c for c in r.columns if c != "firm_id")]
    return made.select(F.when(~F.col(firm[1]), F.col(firm[0])).alias("firm_id"), *before, *(c for c in made.columns if c not in (*firm, *before)))


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    """By the keys, nulls last; for sinks only."""
    return df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))
