"""Register, employment and turnover as views of order tables: customers are firms, segments sectors, regions regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.panel import month_grid


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A firm for each customer; some employees missing, some years implausible, revenues as they are."""
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    place = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("firm_id"),
        F.col("r_name").alias("region_code"),
        F.col("c_mktsegment").alias("nace_code"),
        F.when(F.col("c_custkey") % 50 != 7, (F.col("c_custkey") % 40 + 1).cast("double")).alias("employees"),
        (F.lit(1880) + F.col("c_custkey") % 150).cast("int").alias("foundation_year"),
        F.col("c_acctbal").alias("revenue_last_year"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in every month from the first order's to the last one's."""
    day = F.col("o_orderdate").cast("date")
    span = _read(spark, sf_dir, "orders").agg(F.trunc(F.min(day), "month").alias("first"), F.trunc(F.max(day), "month").alias("last"))  # one row
    return month_grid(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("firm_id")), span, unique=True)


def employment(spark: SparkSession, sf_dir: str, plus: int = 0) -> DataFrame:
    """Employees by a rule with gaps and zeros; ``plus`` is added."""
    k = (F.year("month") - 1990) * 12 + F.month("month")
    return grid(spark, sf_dir).withColumn("employees", F.when((F.col("firm_id") * 31 + k) % 37 != 0, ((F.col("firm_id") * 7 + k * 5) % 30 + plus).cast("double")))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of a customer's orders in a month, missing where there are none: grid and orders under each other, one aggregation."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("o_totalprice").alias("price"), F.lit(False).alias("on_grid"))
    rows = grid(spark, sf_dir).select("firm_id", "month", F.lit(None).cast("double").alias("price"), F.lit(True).alias("on_grid")).unionByName(orders)
    summed = rows.groupBy("firm_id", "month").agg(F.round(F.sum("price"), 2).alias("turnover"), F.max("on_grid").alias("on_grid"))
    return summed.where("on_grid").drop("on_grid")
