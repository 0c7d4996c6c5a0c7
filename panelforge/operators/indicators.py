"""Indicators by year, sector and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.missing import INF, NAN, present

GRAINS = {"sector_region": ["year", "nace_code", "region_code"], "sector": ["year", "nace_code"], "region": ["year", "region_code"]}


def _by_firm(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Partial measures of each firm in each cell: the second step then counts firms without a distinct count."""
    named = panel.withColumn("year", F.year("month"))
    return named.groupBy(*keys, "firm_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(present("turnover_monthly")).alias("t"),
        F.sum(present("employees_monthly")).alias("e"),
        F.sum(present("productivity")).alias("p"),
        F.count(present("productivity")).alias("n_p"),
    )


def _measures(df: DataFrame, empty_nan: bool) -> DataFrame:
    of_nothing = F.lit(NAN) if empty_nan else F.lit(None).cast("double")
    mean = F.when(F.col("n_p") > 0, F.col("p") / F.col("n_p")).otherwise(of_nothing)
    return (
        df.withColumn("total_turnover", F.coalesce("t", F.lit(0.0)))
        .withColumn("avg_turnover_per_firm", F.col("total_turnover") / F.col("n_firms"))
        .withColumn("total_employees", F.coalesce("e", F.lit(0.0)))
        .withColumn("avg_employees_per_firm", F.col("total_employees") / F.col("n_firms"))
        .withColumn("mean_productivity", mean)
        .drop("t", "e", "p", "n_p")
    )


def _totals() -> list:
    return [F.sum("n_obs").alias("n_obs"), F.count(F.lit(1)).alias("n_firms"), F.sum("t").alias("t"), F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("n_p").alias("n_p")]


def indicators(panel: DataFrame, keys: list[str], empty_nan: bool = False) -> DataFrame:
    """Observations, firms (a null one counts), totals, averages per firm and mean productivity of each cell; a null key is a cell of its own."""
    return _measures(_by_firm(panel, keys).groupBy(*keys).agg(*_totals()), empty_nan)


def indicator_cube(panel: DataFrame, empty_nan: bool = False) -> DataFrame:
    """All three grains in one pass; ``grain`` tells them apart, also where a key is null."""
    keys = GRAINS["sector_region"]
    partial = _by_firm(panel, keys)
    # A firm counts once in a cell of any grain, also where it has several sectors or regions.
    cells = partial.select("year", "firm_id", "n_obs", "t", "e", "p", "n_p", F.explode(F.array(*(F.struct(F.lit(g).alias("grain"), *((F.col(k) if k in ks else F.lit(None).cast("string")).alias(k) for k in keys[1:])) for g, ks in GRAINS.items()))).alias("cell"))
    named = cells.select("year", "firm_id", "cell.*", "n_obs", "t", "e", "p", "n_p")
    per_firm = named.groupBy("grain", *keys, "firm_id").agg(*(F.sum(c).alias(c) for c in ("n_obs", "t", "e", "p", "n_p")))
    return _measures(per_firm.groupBy("grain", *keys).agg(*_totals()), empty_nan)


def roll_up(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of finer cells. Firms may be added where each is in one of the finer cells only."""
    return cells.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_obs", "n_firms", "total_turnover", "total_employees")))


def finite(c: str):
    """Null instead of an infinite or missing value, for sinks that can't hold them."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)
