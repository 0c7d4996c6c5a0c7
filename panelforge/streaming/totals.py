"""Monthly totals of a stream of turnover reports; row windows (lags, interpolation) need whole series and stay with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.missing import na_sum


def monthly_totals(reports: DataFrame, time: str = "reported_at", value: str = "turnover", late: str = "45 days") -> DataFrame:
    """(month, total_turnover, n_obs) of the reports' months; reports later than ``late`` behind the newest are left out."""
    month = F.date_trunc("month", F.col(time)).alias("month")
    return reports.withWatermark(time, late).groupBy(month).agg(na_sum(value).alias("total_turnover"), F.count(F.lit(1)).alias("n_obs"))
