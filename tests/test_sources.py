"""Files, generators, the whole run, the stream."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelforge.operators import indicators as ind
from panelforge.operators.panel import fused_panel
from panelforge.plans import stages
from panelforge.sources import generate as gen
from panelforge.sources.tables import SCHEMAS, clean_names, from_lines, read_csv, to_lines, write_csv, write_parquet
from panelforge.streaming.totals import monthly_totals


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,x\na,NA\nb,\nc,"NA"\nd,NaN\ne,Inf\nf,-Inf\ng,1.5\n')
    got = {r["k"]: r["x"] for r in read_csv(spark, str(tmp_path / "a.csv"), "k string, x double").collect()}
    assert got["a"] is None and got["b"] is None and got["c"] is None and math.isnan(got["d"])
    assert (got["e"], got["f"], got["g"]) == (math.inf, -math.inf, 1.5)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 41664.0, dt.date(2023, 1, 1)), ("b", 98208992.67585434, None), (None, None, None), ("c", math.inf, None)], "k string, x double, d date")
    write_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    text = part.read_text()
    assert "a,41664,2023-01-01" in text and "NA,NA,NA" in text and "c,Inf,NA" in text
    back = read_csv(spark, str(tmp_path / "out"), "k string, x double, d date")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,n,x,d\na,1,1.5,2023-01-01\nb,NA,,NA\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("k", "string"), ("n", "int"), ("x", "double"), ("d", "date")] and df.where("n is null and x is null and d is null").count() == 1


def test_lines_are_what_files_hold(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 2.5, None), ("", math.inf, 3), (None, 41664.0, -1)], "k string, x double, n int")
    write_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert [r["line"] for r in to_lines(df.coalesce(1)).collect()] == part.read_text().splitlines()[1:]
    files = read_csv(spark, str(tmp_path / "out"), "k string, x double, n int")
    assert sorted(map(str, from_lines(to_lines(df), "k string, x double, n int").collect())) == sorted(map(str, files.collect()))


def test_parquet_by_year(spark, tmp_path):
    df = spark.createDataFrame([(2022, 1), (2023, 2)], "year int, v int")
    write_parquet(df, str(tmp_path / "p"), ["year"])
    plan = spark.read.parquet(str(tmp_path / "p")).where("year = 2023")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Firm ID", "firmId", "Größe %", "2nd", "a.b"])
    assert clean_names(df).columns == ["firm_id", "firm_id_2", "große_percent".replace("ß", ""), "x2nd", "a_b"]
    for schema in SCHEMAS.values():
        empty = spark.createDataFrame([], schema)
        assert clean_names(empty).columns == empty.columns


@pytest.fixture(scope="module")
def made(spark):
    firms = gen.register(spark, clean=True)
    return gen.register(spark).toPandas(), gen.employment(firms).toPandas(), gen.turnover(firms).toPandas()


def test_distributions(made):
    firms, employment, turnover = made
    assert len(firms) == 1500 and len(employment) == len(turnover) == 18_000
    assert firms["employees"].mean() == pytest.approx(26, rel=0.02) and firms["employees"].isna().mean() == pytest.approx(0.02, abs=0.01)
    assert (firms["revenue_last_year"] < 0).mean() == pytest.approx(0.02, abs=0.01)
    assert firms["foundation_year"].between(1965, 2022).all()
    assert employment["employees"].isna().mean() == pytest.approx(0.01, abs=0.005)
    per_firm = turnover["turnover"].mean() * 12
    assert per_firm == pytest.approx(12 * math.exp(10.5 + 0.8**2 / 2), rel=0.02)
    for code, factors in gen.SEASONALITY.items():
        own = employment[employment["nace_code"] == code]["employees"].mean() * 12
        assert own == pytest.approx(20 * sum(factors), rel=0.02), code


def test_draws_do_not_depend_on_partitions(spark):
    one, many = (gen.turnover(gen.register(spark, 50, clean=True).repartition(n)) for n in (1, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_unknown_sector_has_no_factor(spark):
    df = spark.createDataFrame([("G47", 12), ("X", 1), (None, 1)], "c string, m int")
    assert [r[0] for r in df.select(gen.seasonal_factor(F.col("c"), F.col("m"))).collect()] == [1.6, None, None]


def test_dimensions(spark):
    assert gen.regions(spark).count() == 10 and gen.sectors(spark).count() == 6 and gen.legal_forms(spark).count() == 5
    assert gen.regions(spark).first()[:] == ("R01", "Region 1")


def test_whole_run(spark, tmp_path):
    report = {(r["check"], r["table"]): r for r in stages.run(spark, str(tmp_path), 120, 2023).collect()}
    assert report["unique_keys", "firms"]["n_violations"] == 0 and report["orphan_ids", "turnover"]["n_violations"] == 0
    cells = spark.read.option("header", True).csv(f"{tmp_path}/tables/indicators_sector.csv").toPandas()
    assert cells["n_firms"].astype(int).sum() == 120 and (cells["n_obs"].astype(int) == 12 * cells["n_firms"].astype(int)).all()
    assert (tmp_path / "figures" / "firm_size_distribution.svg").read_text().startswith("<svg")
    assert len(list((tmp_path / "figures").iterdir())) == 3


def test_cells_roll_up(spark):
    """Coarse cells are sums of fine ones; every firm has one sector and one region, and twelve months."""
    firms = gen.register(spark, 200, clean=True)
    panel = fused_panel(gen.employment(firms), gen.turnover(firms), firms.drop("legal_form"))
    fine = ind.indicators(panel, ind.GRAINS["sector_region"]).toPandas()
    assert (fine["n_obs"] == 12 * fine["n_firms"]).all() and fine["n_firms"].sum() == 200
    assert (fine["avg_turnover_per_firm"] == fine["total_turnover"] / fine["n_firms"]).all()
    for grain, key in (("sector", "nace_code"), ("region", "region_code")):
        coarse = ind.indicators(panel, ind.GRAINS[grain]).toPandas().set_index(key)
        rolled = fine.assign(p=fine["mean_productivity"] * fine["n_obs"]).groupby(key).sum(numeric_only=True)
        for c in ("n_obs", "n_firms", "total_turnover", "total_employees"):
            assert coarse[c].to_dict() == pytest.approx(rolled[c].to_dict(), rel=1e-9)
        assert coarse["mean_productivity"].to_dict() == pytest.approx((rolled["p"] / rolled["n_obs"]).to_dict(), rel=1e-9)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2023, 1, 5), 10.0), (dt.datetime(2023, 1, 9), None), (dt.datetime(2023, 2, 1), 5.0)], "reported_at timestamp, turnover double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = monthly_totals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["month"].month: (r["total_turnover"], r["n_obs"]) for r in spark.table("totals").collect()} == {1: (10.0, 2), 2: (5.0, 1)}
