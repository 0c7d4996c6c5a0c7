"""Imputation, panel, indicators, checks, figures."""

from __future__ import annotations

import datetime as dt
import math
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import clean, figures, validate
from panelforge.operators import indicators as ind
from panelforge.operators.panel import build_panel, derive_indicators, fused_panel, month_grid


def month(k: int) -> dt.date:
    return dt.date(2023 + k // 12, k % 12 + 1, 1)


def series(spark, values, firm=1, first=0):
    return spark.createDataFrame([(firm, month(first + k), v) for k, v in enumerate(values)], "firm_id long, month date, y double")


def filled(df, **options):
    return [r["y"] for r in clean.interpolate(df, "y", **options).orderBy("month").collect()]


def test_line_by_days_and_ties(spark):
    assert filled(series(spark, [10.0, None, 13.0], first=6)) == [10.0, 11.5, 13.0]
    assert filled(series(spark, [10.0, None, 13.0], first=6), round_imputed=True) == [10.0, 12.0, 13.0]
    assert filled(series(spark, [12.0, None, 13.0], first=6), round_imputed=True) == [12.0, 12.0, 13.0]
    assert filled(series(spark, [1.5, None, 3.0], first=0))[1] == 1.5 + 1.5 * (31 / 59)
    assert filled(series(spark, [1.5, 2.5]), round_imputed=True) == [1.5, 2.5]  # observed values stay


def test_ends_are_held(spark):
    got = filled(series(spark, [None, 4.0, None, 8.0, None]))
    assert got[:2] == [4.0, 4.0] and got[3:] == [8.0, 8.0] and got[2] == 4.0 + 4.0 * (28 / 59)


def test_short_series(spark):
    assert filled(series(spark, [None, None])) == [None, None]
    assert filled(series(spark, [None, 7.0, float("nan")])) == [7.0, 7.0, 7.0]
    assert filled(series(spark, [1.0]), strict=True) == [1.0]
    with pytest.raises(Exception, match="fewer than two values"):
        filled(series(spark, [None, 7.0]), strict=True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 1000).map(float)), min_size=1, max_size=24))
def test_interpolation_properties(spark, values):
    df = series(spark, values)
    once = filled(df)
    assert filled(series(spark, once)) == once
    known = [v for v in values if v is not None]
    if known:
        assert all(min(known) <= v <= max(known) for v in once)
        assert all(v is None or v == w for v, w in zip(values, once, strict=True))
    assert [r["y"] for r in clean.interpolate(df.repartition(5), "y").orderBy("month").collect()] == once


def test_group_median(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", "x", 2.0), (3, "a", "x", None), (4, None, "x", None), (5, None, "x", 9.0), (6, "b", "x", None)]
    df = spark.createDataFrame(rows, "id int, nace_code string, region_code string, employees double")
    got = {r["id"]: r["employees"] for r in clean.group_median(df, "employees", ["nace_code", "region_code"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 1.5, 4: None, 5: 9.0, 6: None}


def test_register_rules(spark):
    df = spark.createDataFrame([(-5.0, 1899), (5.0, 1900), (None, 2024), (0.0, None)], "revenue_last_year double, foundation_year int")
    got = [tuple(r) for r in clean.plausible_year(clean.positive_revenue(df), 2023).collect()]
    assert got == [(5.0, None), (5.0, 1900), (None, None), (0.0, None)]


def panel_of(spark, months=13):
    e = series(spark, [float(10 + k) for k in range(months)]).withColumnRenamed("y", "employees")
    t = series(spark, [float(100 * (k + 1)) for k in range(months)]).withColumnRenamed("y", "turnover")
    r = spark.createDataFrame([(1, "R01", "C10", 5.0)], "firm_id long, region_code string, nace_code string, employees double")
    return derive_indicators(build_panel(e, t, r))


def test_growth_needs_rows_before(spark):
    rows = panel_of(spark, 12).orderBy("month").collect()
    assert all(r["turnover_yoy"] is None for r in rows) and rows[0]["emp_growth"] is None and rows[1]["emp_growth"] == 0.1
    last = panel_of(spark).orderBy("month").collect()[-1]
    assert last["turnover_yoy"] == 12.0 and last["productivity"] == 1300.0 / 22.0 and last["seasonal_index"] == 1300.0 / 700.0
    assert last["employees_firm"] == 5.0 and last["month_num"] == 1


def test_fused_equals_step_by_step(spark):
    e = [(1, month(k), None if k % 4 == 1 else float(k % 7), 0.5) for k in range(20)] + [(2, month(k), None, 1.0) for k in range(3)] + [(None, month(0), 4.0, 1.0), (3, month(2), 2.0, None)]
    t = [(1, month(k), None if k % 3 == 1 else 10.0 * k) for k in range(2, 25)] + [(None, month(0), 9.0), (4, month(0), 1.0)]
    r = [(1, "R1", "A", 5.0), (2, "R2", "B", None), (None, "R3", "C", 1.0), (9, "R4", "D", 2.0)]
    e = spark.createDataFrame(e, "firm_id int, month date, employees double, seasonal_factor double")
    t = spark.createDataFrame(t, "firm_id int, month date, turnover double")
    r = spark.createDataFrame(r, "firm_id int, region_code string, nace_code string, employees double")
    steps = derive_indicators(build_panel(clean.clean_employment(e), clean.clean_turnover(t), r))
    fused = fused_panel(e, t, r).select(*steps.columns)
    assert fused.schema.simpleString() == steps.schema.simpleString()
    assert sorted(map(str, fused.collect())) == sorted(map(str, steps.collect()))
    plan = fused_panel(e, t, r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "SortAggregate" not in plan


def test_one_exchange_for_all_windows(spark):
    df = panel_of(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 3


def cells(spark):
    rows = [(1, "a", "x", 10.0, 1.0, 10.0), (1, "a", "x", 20.0, 0.0, math.inf), (2, "a", "y", None, None, None), (None, "a", "x", 5.0, 2.0, 2.5), (3, None, "y", 0.0, 0.0, math.nan)]
    return spark.createDataFrame([(f, month(0), n, r, t, e, p) for f, n, r, t, e, p in rows], "firm_id int, month date, nace_code string, region_code string, turnover_monthly double, employees_monthly double, productivity double")


def test_indicators(spark):
    got = {(r["nace_code"], r["region_code"]): r for r in ind.indicators(cells(spark), ind.GRAINS["sector_region"]).collect()}
    a = got["a", "x"]
    assert (a["n_obs"], a["n_firms"], a["total_turnover"], a["avg_turnover_per_firm"], a["total_employees"]) == (3, 2, 35.0, 17.5, 3.0)
    assert a["mean_productivity"] == math.inf
    assert got["a", "y"]["total_turnover"] == 0.0 and got["a", "y"]["mean_productivity"] is None
    assert got[None, "y"]["mean_productivity"] is None and got[None, "y"]["n_firms"] == 1
    strict = ind.indicators(cells(spark), ["nace_code", "region_code"], empty_nan=True).where("region_code = 'y'").collect()
    assert all(math.isnan(r["mean_productivity"]) for r in strict)


def test_cube_equals_the_grains(spark):
    cube = ind.indicator_cube(cells(spark))
    for grain, keys in ind.GRAINS.items():
        own = sorted(map(tuple, ind.indicators(cells(spark), keys).collect()), key=str)
        columns = ind.indicators(cells(spark), keys).columns
        assert sorted(map(tuple, cube.where(F.col("grain") == grain).select(*columns).collect()), key=str) == own


def test_checks(spark):
    register = spark.createDataFrame([(1,), (1,), (None,)], "firm_id int")
    assert validate.unique_keys(register).first()["n_violations"] == 1
    assert validate.orphan_ids(spark.createDataFrame([(2,), (2,), (None,), (3,)], "firm_id int"), register).first()["n_violations"] == 2
    assert validate.any_nonpositive(spark.createDataFrame([(None,), (0.0,)], "employees_monthly double")).first()["n_violations"] == 1
    assert validate.productivity_range(spark.createDataFrame([(math.nan,), (-1.0,), (2e7,), (5.0,)], "productivity double")).first()["n_violations"] == 2
    assert validate.short_series(series(spark, [None, 1.0]), "y", "t").first()["n_violations"] == 1


def test_histogram(spark):
    df = spark.createDataFrame([(float(k),) for k in range(30)] + [(None,)], "x double")
    rows = figures.histogram(df, "x").orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1] * 30 and rows[0]["lo"] == -0.5
    one = figures.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert [(r["bin"], r["n"]) for r in one] == [(0, 2)]
    assert figures.histogram(df.limit(0), "x").count() == 0


def test_grid(spark):
    got = month_grid(spark.createDataFrame([(1,), (1,), (2,)], "firm_id int"), ("2023-01-01", "2023-12-01"))
    assert got.count() == 24 and got.agg(F.max("month")).first()[0] == dt.date(2023, 12, 1)


def test_repeated_months_are_refused(spark):
    e = spark.createDataFrame([(1, month(0), 1.0), (1, month(0), 2.0)], "firm_id int, month date, employees double")
    t = spark.createDataFrame([(1, month(0), 5.0)], "firm_id int, month date, turnover double")
    r = spark.createDataFrame([(1, "R1", "A", 5.0)], "firm_id int, region_code string, nace_code string, employees double")
    assert build_panel(e, t, r).count() == 2
    with pytest.raises(Exception, match="repeated firm and month: 12023"):
        fused_panel(e, t, r).collect()


def test_long_series_take_a_step_a_row(spark):
    """The frames of imputation never run from a row to a series' end."""
    df = series(spark, [1.0, None, 3.0])
    assert "unboundedfollowing" not in clean.interpolate(df, "y")._jdf.queryExecution().executedPlan().toString()


def test_year_without_one_given_is_the_current_one(spark):
    now = dt.date.today().year
    df = spark.createDataFrame([(now,), (now + 2,)], "foundation_year int")
    assert [r[0] for r in clean.plausible_year(df).collect()] == [now, None]


def test_figure_shows_its_rows(tmp_path):
    figures.write_svg(str(tmp_path / "a.svg"), "bar", [("a<", 1.0), ("b", 2.0), ("c", None)], "T & U", "x", "y")
    root = ElementTree.parse(tmp_path / "a.svg").getroot()
    heights = [float(x.get("height")) for x in root.iter("{http://www.w3.org/2000/svg}rect")]
    texts = [x.text for x in root.iter("{http://www.w3.org/2000/svg}text")]
    assert heights[1] == 2 * heights[0] > 0 == heights[2] and {"T & U", "x", "y", "a<", "b", "c"} <= set(texts)
    figures.write_svg(str(tmp_path / "b.svg"), "line", [("a", 1.0), ("b", 4.0)], "t", "x", "y")
    (line,) = ElementTree.parse(tmp_path / "b.svg").getroot().iter("{http://www.w3.org/2000/svg}polyline")
    assert len(line.get("points").split()) == 2
