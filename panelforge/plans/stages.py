"""The whole run: generate, clean, integrate, indicators, figures. Each stage reads what the last one wrote.

``python -m panelforge.plans.stages FOLDER [--firms N]``
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.missing import six_number_summary
from panelforge.operators import clean, figures, validate
from panelforge.operators import indicators as ind
from panelforge.operators.panel import build_panel, derive_indicators, sorted_rows
from panelforge.sources import generate as gen
from panelforge.sources.tables import SCHEMAS, clean_names, read_csv, write_csv

log = logging.getLogger("panelforge")


def session(cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that results rely on; on a cluster, set them there."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelforge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    return (builder.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else builder).getOrCreate()


def _read(spark: SparkSession, folder: str, part: str, name: str) -> DataFrame:
    return clean_names(read_csv(spark, f"{folder}/{part}/{name}.csv", SCHEMAS[name.removesuffix("_clean")]))


def generate(spark: SparkSession, folder: str, firms: int = gen.FIRMS, seed: int = gen.SEED) -> None:
    base = gen.register(spark, firms, seed, clean=True)
    write_csv(gen.register(spark, firms, seed), f"{folder}/raw/firms.csv", False)
    write_csv(gen.employment(base, seed), f"{folder}/raw/employment.csv", False)
    write_csv(gen.turnover(base, seed), f"{folder}/raw/turnover.csv", False)
    log.info("synthetic tables written")


def clean_all(spark: SparkSession, folder: str, as_of_year: int | None = None) -> None:
    firms, employment, turnover = (_read(spark, folder, "raw", n) for n in ("firms", "employment", "turnover"))
    write_csv(clean.clean_register(firms, as_of_year), f"{folder}/clean/firms_clean.csv", False)
    write_csv(clean.clean_employment(employment), f"{folder}/clean/employment_clean.csv", False)
    write_csv(clean.clean_turnover(turnover), f"{folder}/clean/turnover_clean.csv", False)
    log.info("cleaned tables written")


def integrate(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the panel; returns the report of all checks, which are logged as warnings and never raise."""
    firms, employment, turnover = (_read(spark, folder, "clean", f"{n}_clean") for n in ("firms", "employment", "turnover"))
    panel = derive_indicators(build_panel(employment, turnover, firms))
    write_csv(panel.select(*(f.split()[0] for f in SCHEMAS["panel"].split(", "))), f"{folder}/processed/panel_data.csv", False)
    written = read_csv(spark, f"{folder}/processed/panel_data.csv", SCHEMAS["panel"])
    report = validate.report(firms, employment, turnover, written)
    for r in report.collect():  # one row for each check
        (log.warning if r["n_violations"] else log.info)("%s on %s: %s violations, detail %s", r["check"], r["table"], r["n_violations"], r["detail"])
    log.info("growth on last year: %s", six_number_summary(written, "turnover_yoy").first())
    return report


def write_indicators(spark: SparkSession, folder: str) -> None:
    panel = read_csv(spark, f"{folder}/processed/panel_data.csv", SCHEMAS["panel"])
    for grain, keys in ind.GRAINS.items():
        write_csv(sorted_rows(ind.indicators(panel, keys), *keys), f"{folder}/tables/indicators_{grain}.csv")


def draw(spark: SparkSession, folder: str) -> None:
    """Three SVG files; only bins, cells and months reach the driver."""
    panel = read_csv(spark, f"{folder}/processed/panel_data.csv", SCHEMAS["panel"])
    bars = figures.histogram(figures.firm_size(panel), "avg_employees").orderBy("bin").collect()
    cells = ind.indicators(panel, ind.GRAINS["sector"])
    flat = sorted_rows(figures.turnover_by_sector(cells), "nace_code").collect()
    line = sorted_rows(figures.monthly_turnover(panel), "month").collect()
    data = {
        "firm_size_distribution": ("bar", [(f"{(r['lo'] + r['hi']) / 2:.0f}", r["n"]) for r in bars]),
        "avg_turnover_by_sector": ("flat", [(r[0], r[1]) for r in flat]),
        "monthly_turnover_total": ("line", [(r[0], r[1]) for r in line]),
    }
    year = cells.agg(F.max("year")).first()[0]
    for name, (kind, rows) in data.items():
        title, x_label, y_label = figures.LABELS[name]
        figures.write_svg(f"{folder}/figures/{name}.svg", kind, rows, title.format(year=year), x_label, y_label)


def run(spark: SparkSession, folder: str, firms: int = gen.FIRMS, as_of_year: int | None = None) -> DataFrame:
    """All stages in order; returns the report of the checks."""
    generate(spark, folder, firms)
    clean_all(spark, folder, as_of_year)
    report = integrate(spark, folder)
    write_indicators(spark, folder)
    draw(spark, folder)
    return report


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("folder")
    parser.add_argument("--firms", type=int, default=gen.FIRMS)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    run(session(), args.folder, args.firms).show(truncate=False)
