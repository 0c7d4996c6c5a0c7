"""Schemas and files: CSV with NA cells, Parquet, column names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "firms": "firm_id string, region_code string, nace_code string, legal_form string, employees double, foundation_year int, revenue_last_year double",
    "employment": "firm_id string, month date, nace_code string, region_code string, month_num int, seasonal_factor double, employees double",
    "turnover": "firm_id string, month date, nace_code string, region_code string, turnover double",
    "panel": "firm_id string, month date, month_num int, seasonal_factor double, employees_monthly double, turnover_monthly double, region_code string, nace_code string, legal_form string, employees_firm double, foundation_year int, revenue_last_year double, turnover_yoy double, emp_growth double, productivity double, seasonal_index double",
}


#: How cells are read and written, in files and in columns of text alike.
READ = {"nullValue": "NA", "positiveInf": "Inf", "negativeInf": "-Inf"}
WRITE = {"nullValue": "NA", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; empty cells and NA, quoted or not, are missing, Inf and NaN are doubles. Without a schema types are inferred."""
    reader = spark.read.option("header", True).options(**READ)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def plain_number(c: str):
    """A double as text that reads back equal, whole numbers without a fraction."""
    x = F.col(c)
    text = F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x == float("inf"), "Inf").when(x == -float("inf"), "-Inf")
    return text.when((F.abs(x) < 1e15) & (x == F.floor(x)), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")).alias(c)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header, missing cells as NA. One file is for aggregates; large tables stay in parts."""
    plain = _plain(df)
    (plain.coalesce(1) if one_file else plain).write.mode("overwrite").option("header", True).options(**WRITE).csv(path)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(plain_number(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def to_lines(df: DataFrame) -> DataFrame:
    """(line): each row as a line of CSV, as ``write_csv`` puts it into a file."""
    return _plain(df).select(F.to_csv(F.struct("*"), WRITE).alias("line"))


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The rows of CSV lines, as ``read_csv`` reads them from a file."""
    return lines.select(F.from_csv("line", schema, READ).alias("row")).select("row.*")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """The native format; ``by`` makes a folder for each value, for partition pruning."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in snake case: ASCII letters, digits and underscores; repeated names get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        ascii_name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", ascii_name.replace("%", "_percent_").replace("#", "_number_"))
        clean = re.sub(r"[^0-9a-zA-Z]+", "_", parts).strip("_").lower() or "x"
        clean = f"x{clean}" if clean[0].isdigit() else clean
        seen[clean] = seen.get(clean, 0) + 1
        out.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return df.toDF(*out)
