"""Made-up register, employment and turnover of firms, with errors put in; keyed draws, so any part can be made alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import draws
from panelforge.functions.missing import at_least, half_even

# Code lists and monthly factors by sector.
REGIONS = [f"R{k:02d}" for k in range(1, 11)]
SECTORS = {"G47": "Retail Trade", "C10": "Food Manufacturing", "C29": "Automotive Manufacturing", "H49": "Land Transport", "I55": "Accommodation", "I56": "Food & Beverage Services"}
LEGAL_FORMS = ["AG", "GmbH", "KG", "OHG", "Einzelunternehmen"]
SEASONALITY = {
    "G47": [1.00, 0.98, 1.00, 1.02, 1.05, 1.08, 1.10, 1.12, 1.15, 1.20, 1.40, 1.60],
    "C10": [1.00, 1.00, 1.01, 1.01, 1.02, 1.02, 1.03, 1.00, 1.00, 1.01, 1.01, 1.02],
    "C29": [1.00, 1.00, 1.00, 1.02, 1.02, 1.03, 1.03, 0.80, 1.00, 1.02, 1.03, 1.05],
    "H49": [1.00, 1.01, 1.01, 1.02, 1.03, 1.05, 1.07, 1.06, 1.05, 1.03, 1.02, 1.01],
    "I55": [0.70, 0.75, 0.90, 1.10, 1.40, 1.60, 1.80, 1.70, 1.40, 1.10, 0.80, 0.70],
    "I56": [0.85, 0.90, 0.95, 1.05, 1.15, 1.20, 1.30, 1.25, 1.10, 1.00, 0.95, 0.90],
}
SEED, FIRMS = 2025, 1500


def regions(spark: SparkSession) -> DataFrame:
    return spark.range(1, 11).select(F.format_string("R%02d", "id").alias("region_code"), F.concat_ws(" ", F.lit("Region"), F.col("id").cast("string")).alias("region_name"))


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SECTORS.items()), "nace_code string, industry_name string")


def legal_forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LEGAL_FORMS], "legal_form string")


def seasonal_factor(code, month_num):
    """The factor of a sector and month (1 to 12); null for an unknown sector."""
    factors = F.create_map(*(x for k, v in SEASONALITY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.element_at(F.try_element_at(factors, code), month_num)


def register(spark: SparkSession, firms: int = FIRMS, seed: int = SEED, clean: bool = False) -> DataFrame:
    """A row for each of ``firms`` firms."""
    return register_of(spark.range(1, firms + 1), seed, clean)


def register_of(numbers: DataFrame, seed: int = SEED, clean: bool = False) -> DataFrame:
    """A row for each ``id``; 2 % of employees missing and 2 % of revenues negative unless ``clean``."""
    u = lambda name: draws.uniform(seed, name, "firm_id")
    df = numbers.select(F.format_string("F%05d", "id").alias("firm_id"))
    df = df.select(
        "firm_id",
        draws.choice(u("region"), REGIONS).alias("region_code"),
        draws.choice(u("sector"), list(SECTORS)).alias("nace_code"),
        draws.choice(u("form"), LEGAL_FORMS).alias("legal_form"),
        (draws.poisson(u("size"), 25) + 1).cast("double").alias("employees"),
        draws.whole(u("founded"), 1965, 2022).alias("foundation_year"),
        F.round(draws.log_normal(u("revenue"), u("revenue2"), 12, 1), 2).alias("revenue_last_year"),
    )
    if clean:
        return df
    flipped = F.when(u("negative") < 0.02, -F.col("revenue_last_year")).otherwise(F.col("revenue_last_year"))
    return df.withColumn("employees", draws.missing(u("no_size"), 0.02, F.col("employees"))).withColumn("revenue_last_year", flipped)


def months(first: str = "2023-01-01", last: str = "2023-12-01"):
    """An array of the first days of months."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def _grid(firms: DataFrame) -> DataFrame:
    return firms.select("firm_id", "nace_code", "region_code").withColumn("month", F.explode(months()))


def employment(firms: DataFrame, seed: int = SEED) -> DataFrame:
    """Monthly employees: Poisson with mean 20, at least 1, times the season, rounded; 1 % missing."""
    u = lambda name: draws.uniform(seed, name, "firm_id", "month")
    df = _grid(firms).withColumn("month_num", F.month("month")).withColumn("seasonal_factor", seasonal_factor(F.col("nace_code"), F.col("month_num")))
    base = at_least(1, draws.poisson(u("staff"), 20))
    people = half_even(base * F.col("seasonal_factor"))
    return df.select("firm_id", "month", "nace_code", "region_code", "month_num", "seasonal_factor", draws.missing(u("no_staff"), 0.01, people).alias("employees"))


def turnover(firms: DataFrame, seed: int = SEED) -> DataFrame:
    """Monthly turnover: log-normal, to cents; 1 % missing."""
    u = lambda name: draws.uniform(seed, name, "firm_id", "month")
    money = F.round(draws.log_normal(u("sales"), u("sales2"), 10.5, 0.8), 2)
    return _grid(firms).select("firm_id", "month", "nace_code", "region_code", draws.missing(u("no_sales"), 0.01, money).alias("turnover"))
