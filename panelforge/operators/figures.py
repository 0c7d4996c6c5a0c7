"""Data of the figures, and a small writer of SVG files."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.functions.missing import na_mean, na_sum

# Title, horizontal and vertical label of each figure.
LABELS = {
    "firm_size_distribution": ("Firm Size Distribution (Average Employees per Firm)", "Average Number of Employees", "Number of Firms"),
    "avg_turnover_by_sector": ("Average Turnover per Firm by Sector ({year})", "NACE Code", "Average Turnover per Firm"),
    "monthly_turnover_total": ("Monthly Total Turnover (All Firms)", "Month", "Total Turnover"),
}


def labels(panel: DataFrame) -> DataFrame:
    """(figure, title, x_label, y_label); titles name the panel's latest year."""
    rows = panel.sparkSession.createDataFrame([(k, *v) for k, v in LABELS.items()], "figure string, title string, x_label string, y_label string")
    latest = panel.agg(F.year(F.max("month")).cast("string").alias("year"))  # one row
    return rows.crossJoin(F.broadcast(latest)).select("figure", F.replace("title", F.lit("{year}"), "year").alias("title"), "x_label", "y_label")


def firm_size(panel: DataFrame) -> DataFrame:
    """(firm_id, avg_employees)."""
    return panel.groupBy("firm_id").agg(na_mean("employees_monthly").alias("avg_employees"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n): bins of equal width, closed on the right, the outer ones centred on the least and the greatest value.

    Empty bins are kept; if all values are equal there is one bin. Missing values aren't counted.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    width = F.when(F.col("hi0") > F.col("lo0"), (F.col("hi0") - F.col("lo0")) / (bins - 1)).otherwise(F.lit(0.0))
    bounds = x.agg(F.min("x").alias("lo0"), F.max("x").alias("hi0")).where("lo0 is not null").withColumn("w", width)  # one row
    place = F.when(F.col("w") > 0, F.greatest(F.ceil(F.try_divide(F.col("x") - (F.col("lo0") - F.col("w") / 2), F.col("w"))) - 1, F.lit(0))).otherwise(F.lit(0)).cast("int")
    counted = x.crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.when(F.col("w") > 0, F.lit(bins - 1)).otherwise(F.lit(0)))))
    edge = F.col("lo0") - F.col("w") / 2
    return frame.select("bin", (edge + F.col("bin") * F.col("w")).alias("lo"), (edge + (F.col("bin") + 1) * F.col("w")).alias("hi")).join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def turnover_by_sector(sector_indicators: DataFrame) -> DataFrame:
    """(nace_code, avg_turnover_per_firm) of the latest year."""
    # Cells are few, a row for each year and sector; the panel behind them is read once.
    latest = sector_indicators.withColumn("latest", F.max("year").over(Window.partitionBy()))
    return latest.where(F.col("year") == F.col("latest")).select("nace_code", "avg_turnover_per_firm")


def monthly_turnover(panel: DataFrame) -> DataFrame:
    """(month, total_turnover)."""
    return panel.groupBy("month").agg(na_sum("turnover_monthly").alias("total_turnover"))


def write_svg(path: str, kind: str, rows: list[tuple], title: str, x_label: str, y_label: str, width: int = 700, height: int = 500) -> None:
    """Bars, flat bars or a line of (label, value) rows. Rows are few: cells, bins or months."""
    left, right, top, bottom = 110, 20, 50, 60
    w, h = width - left - right, height - top - bottom
    values = [float(v or 0) for _, v in rows]
    most = max([v for v in values if v == v] or [1.0]) or 1.0
    n = max(1, len(rows))
    body = []
    if kind == "line":
        points = " ".join(f"{left + w * (k + 0.5) / n:.1f},{top + h * (1 - v / most):.1f}" for k, v in enumerate(values))
        body.append(f'<polyline fill="none" stroke="#333" points="{points}"/>')
    for k, ((label, _), v) in enumerate(zip(rows, values, strict=True)):
        text = escape(str(label))
        if kind == "flat":
            y = top + h * k / n
            body.append(f'<rect x="{left}" y="{y:.1f}" width="{max(0.0, w * v / most):.1f}" height="{0.8 * h / n:.1f}" fill="#555"/><text x="{left - 6}" y="{y + 0.5 * h / n:.1f}" text-anchor="end">{text}</text>')
        else:
            x = left + w * k / n
            if kind == "bar":
                body.append(f'<rect x="{x:.1f}" y="{top + h * (1 - v / most):.1f}" width="{0.9 * w / n:.1f}" height="{max(0.0, h * v / most):.1f}" fill="#555"/>')
            if k % max(1, n // 6) == 0:
                body.append(f'<text x="{x + 0.45 * w / n:.1f}" y="{top + h + 18}" text-anchor="middle">{text}</text>')
    x_name, y_name = (y_label, x_label) if kind == "flat" else (x_label, y_label)
    frame = f'<text x="{width / 2}" y="24" text-anchor="middle" font-size="15">{escape(title)}</text><text x="{left + w / 2}" y="{height - 12}" text-anchor="middle">{escape(x_name)}</text><text x="16" y="{top + h / 2}" text-anchor="middle" transform="rotate(-90 16 {top + h / 2})">{escape(y_name)}</text>'
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">{frame}{"".join(body)}</svg>\n')
