"""Missing values, division, order."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.functions import missing as na
from panelforge.operators.panel import left_join, sorted_rows

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("t", "b", "want"), [(1.0, 0.0, INF), (0.0, 0.0, NAN), (-1.0, 0.0, -INF), (None, 0.0, None), (4.0, 2.0, 2.0), (4.0, None, None), (NAN, 0.0, NAN), (INF, INF, NAN)])
def test_division(spark, t, b, want):
    got = frame(spark, [(t, b)], "t double, b double").select(na.ieee_divide("t", "b")).first()[0]
    assert got is None if want is None else (math.isnan(got) if math.isnan(want) else got == want)


def test_aggregates_skip_null_and_nan(spark):
    df = frame(spark, [(1.0,), (NAN,), (None,), (3.0,)], "x double")
    assert df.agg(na.na_sum("x"), na.na_mean("x")).first()[:] == (4.0, 2.0)
    assert df.agg(na.na_n_distinct("x")).first()[0] == 4  # null and NaN are values


def test_aggregates_of_nothing(spark):
    df = frame(spark, [(None,), (None,)], "x double")
    row = df.agg(na.na_sum("x"), na.na_mean("x"), na.na_mean("x", True), na.na_n_distinct("x"), na.na_any(F.col("x") > 0)).first()
    assert row[0] == 0.0 and row[1] is None and math.isnan(row[2]) and row[3] == 1 and row[4] is False
    assert df.limit(0).agg(na.na_sum("x"), na.na_any(F.col("x") > 0)).first()[:] == (0.0, False)


def test_nan_meets_no_bound(spark):
    df = frame(spark, [(NAN,), (2e7,), (-1.0,), (None,), (INF,)], "x double")
    assert df.where(na.greater("x", 1e7)).count() == 2
    assert df.where(na.less("x", 0)).count() == 1


def test_condition_that_is_null(spark):
    df = frame(spark, [(None,), (1,), (-1,)], "x int")
    assert [r[0] for r in df.select(na.na_case(F.col("x") < 0, F.lit("neg"), F.lit("pos"))).collect()] == [None, "pos", "neg"]
    assert [r[0] for r in df.select(na.at_least(0, "x")).collect()] == [None, 1, 0]


def test_half_even(spark):
    df = frame(spark, [(11.5,), (12.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(na.half_even("x")).collect()] == [12.0, 12.0, 0.0]


def test_correlation(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0), (5.0, None), (NAN, 3.0)], "a double, b double")
    assert df.agg(na.pairwise_corr("a", "b")).first()[0] == pytest.approx(0.9933992677987828)
    assert frame(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(na.pairwise_corr("a", "b")).first()[0] is None


def test_six_numbers(spark):
    df = frame(spark, [(1.0,), (2.0,), (5.0,), (None,), (NAN,)], "x double")
    assert na.six_number_summary(df, "x").first()[:] == (1.0, 1.5, 2.0, 8 / 3, 3.5, 5.0, 2)
    empty = na.six_number_summary(frame(spark, [(None,)], "x double"), "x").first()
    assert empty["n_missing"] == 1 and empty["median"] is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False), st.sampled_from([0.0, 1.0, 1e300, INF, -INF])), min_size=1, max_size=60), st.sampled_from([2, 3, 1024]))
def test_order_statistics(spark, values, bins):
    df = frame(spark, [(v,) for v in values], "x double")
    assert na.order_statistics(df, "x", range(len(values)), bins) == dict(enumerate(sorted(values)))


def test_text_that_is_no_value(spark):
    df = frame(spark, [("2023-02-30", "x"), ("2023-02-01", "1.5"), (None, None), ("n/a", "")], "d string, x string")
    rows = df.select(na.as_date("d").cast("string"), na.as_number("x")).collect()
    assert [tuple(r) for r in rows] == [(None, None), ("2023-02-01", 1.5), (None, None), (None, None)]


def test_null_keys_match_and_names_collide(spark):
    a = frame(spark, [(None, 1), (1, 2), (2, 3)], "k int, v int")
    b = frame(spark, [(None, 10), (1, 20), (1, 21)], "k int, v int")
    out = left_join(a, b, ["k"])
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 1, 10), (1, 2, 20), (1, 2, 21), (2, 3, None)], key=str)


def test_set_difference(spark):
    a, b = frame(spark, [(1,), (None,), (1,), (2,)], "k int"), frame(spark, [(2,)], "k int")
    assert {r[0] for r in na.set_difference(a, b, ["k"]).collect()} == {1, None}


def test_nulls_sort_last(spark):
    df = frame(spark, [(None, 1), (2, 1), (1, None), (1, 3)], "a int, b int")
    assert [tuple(r) for r in sorted_rows(df, "a", "b").collect()] == [(1, 3), (1, None), (2, 1), (None, 1)]
