"""Queries over the order tables' views, and the same in SQL for another engine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import missing as na
from panelforge.functions.draws import poisson_table, uniform_sql
from panelforge.operators import clean, figures, validate
from panelforge.operators import indicators as ind
from panelforge.operators import panel as pan
from panelforge.sources import adapters as ad
from panelforge.sources import generate as gen
from panelforge.sources.tables import SCHEMAS, from_lines, to_lines

AS_OF = 2023
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---- SQL building blocks -------------------------------------------------------------------------------------

_REGISTER = """register AS (
  SELECT c_custkey AS firm_id, r_name AS region_code, c_mktsegment AS nace_code,
         CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE CAST(c_custkey % 40 + 1 AS DOUBLE) END AS employees,
         CAST(1880 + c_custkey % 150 AS INTEGER) AS foundation_year, c_acctbal AS revenue_last_year
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_GRID = """grid AS (
  SELECT c_custkey AS firm_id, CAST(m AS DATE) AS month FROM customer,
  (SELECT unnest(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP), CAST(date_trunc('month', max(o_orderdate)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM orders) AS t)"""


def _employment(plus: int = 0) -> str:
    return f"""employment AS (
  SELECT firm_id, month, CASE WHEN (firm_id * 31 + k) % 37 = 0 THEN NULL ELSE CAST((firm_id * 7 + k * 5) % 30 + {plus} AS DOUBLE) END AS employees
  FROM (SELECT firm_id, month, (year(month) - 1990) * 12 + month(month) AS k FROM grid) AS g)"""


_TURNOVER = """turnover AS (
  SELECT g.firm_id, g.month, s.turnover FROM grid g LEFT JOIN (
    SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS turnover
    FROM orders GROUP BY 1, 2) s ON s.o_custkey = g.firm_id AND s.month = g.month)"""
_CLEAN_REGISTER = f"""register_clean AS (
  SELECT firm_id, region_code, nace_code,
         coalesce(employees, median(employees) OVER (PARTITION BY nace_code, region_code)) AS employees,
         CASE WHEN foundation_year BETWEEN 1900 AND {AS_OF} THEN foundation_year END AS foundation_year,
         abs(revenue_last_year) AS revenue_last_year
  FROM register)"""


def _interpolate(name: str, source: str, col: str, rounded: bool) -> str:
    filled = f"""CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
              ELSE pv + (nv - pv) * (CAST(date_diff('day', pm, month) AS DOUBLE) / CAST(date_diff('day', pm, nm) AS DOUBLE)) END"""
    value = f"round_even({filled}, 0)" if rounded else filled
    return f"""{name} AS (
  SELECT firm_id, month, CASE WHEN {col} IS NOT NULL THEN {col} ELSE {value} END AS {col}
  FROM (SELECT firm_id, month, {col},
               last_value({col} IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN {col} IS NOT NULL THEN month END IGNORE NULLS) OVER b AS pm,
               first_value({col} IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN {col} IS NOT NULL THEN month END IGNORE NULLS) OVER a AS nm
        FROM {source}
        WINDOW b AS (PARTITION BY firm_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY firm_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS w)"""


def _div(t: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN {t} / {b} WHEN {b} = 0 THEN CASE WHEN {t} > 0 THEN CAST('inf' AS DOUBLE) WHEN {t} < 0 THEN CAST('-inf' AS DOUBLE) WHEN {t} = 0 THEN CAST('nan' AS DOUBLE) END END)"


_PANEL = """panel0 AS (
  SELECT e.firm_id, e.month, e.employees AS employees_monthly, t.turnover AS turnover_monthly, r.region_code, r.nace_code,
         r.employees AS employees_firm, r.foundation_year, r.revenue_last_year
  FROM employment_clean e LEFT JOIN turnover_clean t ON e.firm_id IS NOT DISTINCT FROM t.firm_id AND e.month IS NOT DISTINCT FROM t.month
  LEFT JOIN register_clean r ON e.firm_id IS NOT DISTINCT FROM r.firm_id)"""
_DERIVED = f"""panel AS (
  SELECT *, {_div("(turnover_monthly - t12)", "t12")} AS turnover_yoy, {_div("(employees_monthly - e1)", "e1")} AS emp_growth,
         {_div("turnover_monthly", "employees_monthly")} AS productivity, {_div("turnover_monthly", "tm")} AS seasonal_index
  FROM (SELECT *, lag(turnover_monthly, 12) OVER w AS t12, lag(employees_monthly, 1) OVER w AS e1,
               avg(turnover_monthly) OVER (PARTITION BY firm_id) AS tm
        FROM panel0 WINDOW w AS (PARTITION BY firm_id ORDER BY month)) AS l)"""


def _base(plus: int = 0) -> list[str]:
    return [_REGISTER, _GRID, _employment(plus), _TURNOVER]


def _chain(plus: int = 0) -> list[str]:
    return [*_base(plus), _CLEAN_REGISTER, _interpolate("employment_clean", "employment", "employees", True), _interpolate("turnover_clean", "turnover", "turnover", False), _PANEL, _DERIVED]


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# ---- views on the Spark side ---------------------------------------------------------------------------------


def _panel0(spark: SparkSession, d: str, plus: int = 0) -> DataFrame:
    return pan.build_panel(clean.clean_employment(ad.employment(spark, d, plus)), clean.clean_turnover(ad.turnover(spark, d)), clean.clean_register(ad.register(spark, d), AS_OF))


def _panel(spark: SparkSession, d: str, plus: int = 0) -> DataFrame:
    return pan.fused_panel(ad.employment(spark, d, plus), ad.turnover(spark, d), clean.clean_register(ad.register(spark, d), AS_OF))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Aggregates of doubles depend on the order of addition in their last bits; both engines round them."""
    return df.select(*(F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return note


# ---- cleaning ------------------------------------------------------------------------------------------------


@_query(_with([_REGISTER, _CLEAN_REGISTER], "SELECT * FROM register_clean"))
def clean_register_all_rules(spark, d):
    return clean.clean_register(ad.register(spark, d), AS_OF)


@_query(_with([_REGISTER], "SELECT firm_id, CASE WHEN revenue_last_year < 0 THEN abs(revenue_last_year) ELSE revenue_last_year END AS revenue_last_year FROM register"))
def register_negative_revenue_fix(spark, d):
    return clean.positive_revenue(ad.register(spark, d)).select("firm_id", "revenue_last_year")


@_query(_with([_REGISTER, _CLEAN_REGISTER], "SELECT firm_id, employees FROM register_clean"))
def register_group_median_impute(spark, d):
    return clean.group_median(ad.register(spark, d), "employees", ["nace_code", "region_code"]).select("firm_id", "employees")


@_query(_with([_REGISTER, _CLEAN_REGISTER], "SELECT firm_id, foundation_year FROM register_clean"))
def register_foundation_year_window(spark, d):
    return clean.plausible_year(ad.register(spark, d), AS_OF).select("firm_id", "foundation_year")


@_query(_with([_GRID], "SELECT firm_id, month FROM grid"))
def month_grid(spark, d):
    return ad.grid(spark, d)


@_query(_with([_GRID, _TURNOVER, _interpolate("turnover_clean", "turnover", "turnover", False)], "SELECT firm_id, month, turnover FROM turnover_clean"))
def interpolate_turnover(spark, d):
    return clean.clean_turnover(ad.turnover(spark, d))


@_query(_with([_GRID, _employment(), _interpolate("employment_clean", "employment", "employees", True)], "SELECT firm_id, month, employees FROM employment_clean"))
def interpolate_employment_rounded(spark, d):
    return clean.clean_employment(ad.employment(spark, d))


# ---- joins and the panel -------------------------------------------------------------------------------------

_PANEL_COLUMNS = "firm_id, month, employees_monthly, turnover_monthly, region_code, nace_code, employees_firm, foundation_year, revenue_last_year"


@_query(_with(_chain(), f"SELECT {_PANEL_COLUMNS} FROM panel0"))
def panel_left_join_two_keys(spark, d):
    return _panel0(spark, d)


@_query(
    "WITH l AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey AS id FROM customer), r AS (SELECT nullif(n_nationkey, 3) AS k, n_name AS name FROM nation) "
    "SELECT l.k, l.id, r.name FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k"
)
def left_join_null_safe_keys(spark, d):
    left = ad._read(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"), F.col("c_custkey").alias("id"))
    right = ad._read(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k"), F.col("n_name").alias("name"))
    return pan.left_join(left, right, ["k"])


@_query(_with(_chain(), "SELECT firm_id, month, turnover_yoy FROM panel"))
def lag12_turnover_yoy(spark, d):
    return _panel(spark, d).select("firm_id", "month", "turnover_yoy")


@_query(_with(_chain(), "SELECT firm_id, month, emp_growth FROM panel"))
def lag1_emp_growth(spark, d):
    return _panel(spark, d).select("firm_id", "month", "emp_growth")


@_query(_with(_chain(), "SELECT firm_id, month, productivity FROM panel"))
def productivity_ratio(spark, d):
    return _panel(spark, d).select("firm_id", "month", "productivity")


@_query(_with(_chain(), "SELECT firm_id, month, round(seasonal_index, 8) AS seasonal_index FROM panel"))
def seasonal_index(spark, d):
    return _rounded(_panel(spark, d).select("firm_id", "month", "seasonal_index"), seasonal_index=8)


@_query(_with(_chain(1), "SELECT firm_id, month, CAST(month(month) AS INTEGER) AS month_num, turnover_yoy, emp_growth, productivity, round(seasonal_index, 8) AS seasonal_index FROM panel"))
def derive_indicators_full(spark, d):
    df = _panel(spark, d, 1).select("firm_id", "month", "month_num", "turnover_yoy", "emp_growth", "productivity", "seasonal_index")
    return _rounded(df, seasonal_index=8)


# ---- indicators ----------------------------------------------------------------------------------------------

_DIGITS = {"total_turnover": 2, "avg_turnover_per_firm": 4, "avg_employees_per_firm": 6, "mean_productivity": 4}


def _cells(keys: list[str], source: str = "panel") -> str:
    return f"""SELECT {", ".join(keys)}, n_obs, n_firms, round(total_turnover, 2) AS total_turnover, round(total_turnover / n_firms, 4) AS avg_turnover_per_firm,
       total_employees, round(total_employees / n_firms, 6) AS avg_employees_per_firm, round(mean_productivity, 4) AS mean_productivity
FROM (SELECT {", ".join("CAST(year(month) AS INTEGER) AS year" if k == "year" else k for k in keys)}, count(*) AS n_obs, count(DISTINCT firm_id) AS n_firms,
             coalesce(sum(turnover_monthly), 0) AS total_turnover, coalesce(sum(employees_monthly), 0) AS total_employees,
             avg(CASE WHEN NOT isnan(productivity) THEN productivity END) AS mean_productivity
      FROM {source} GROUP BY {", ".join("year(month)" if k == "year" else k for k in keys)}) AS c"""


def _indicators(keys: list[str], plus: int) -> Query:
    return lambda spark, d: _rounded(ind.indicators(_panel(spark, d, plus), keys), **_DIGITS)


@_query(_with(_chain(1), _cells(ind.GRAINS["sector_region"])))
def indicators_sector_region_year(spark, d):
    return _indicators(ind.GRAINS["sector_region"], 1)(spark, d)


@_query(_with(_chain(0), _cells(ind.GRAINS["sector_region"])))
def indicators_with_zero_employment(spark, d):
    return _indicators(ind.GRAINS["sector_region"], 0)(spark, d)


@_query(_with(_chain(1), _cells(ind.GRAINS["sector"])))
def indicators_sector_year(spark, d):
    return _indicators(ind.GRAINS["sector"], 1)(spark, d)


@_query(_with(_chain(1), _cells(ind.GRAINS["region"])))
def indicators_region_year(spark, d):
    return _indicators(ind.GRAINS["region"], 1)(spark, d)


_CUBE = "\nUNION ALL\n".join(
    "SELECT " + f"'{g}' AS grain, year, " + ("nace_code" if "nace_code" in ks else "CAST(NULL AS VARCHAR) AS nace_code") + ", " + ("region_code" if "region_code" in ks else "CAST(NULL AS VARCHAR) AS region_code")
    + ", n_obs, n_firms, total_turnover, avg_turnover_per_firm, total_employees, avg_employees_per_firm, mean_productivity FROM (" + _cells(ks) + f") AS cells_{g}"
    for g, ks in ind.GRAINS.items()
)


@_query(_with(_chain(1), _CUBE))
def indicators_cube(spark, d):
    return _rounded(ind.indicator_cube(_panel(spark, d, 1)), **_DIGITS)


# ---- checks --------------------------------------------------------------------------------------------------


def _check(name: str, table: str, select: str) -> str:
    """select gives n and detail."""
    return f"SELECT '{name}' AS \"check\", '{table}' AS \"table\", CAST(n AS BIGINT) AS n_violations, CAST(detail AS DOUBLE) AS detail FROM ({select}) AS x"


_DUPLICATED = "register2 AS (SELECT CASE WHEN firm_id % 11 = 0 THEN NULL ELSE firm_id - firm_id % 3 END AS firm_id FROM register)"
_UNIQUE = "SELECT count(*) - (count(DISTINCT firm_id) + coalesce(max(CASE WHEN firm_id IS NULL THEN 1 ELSE 0 END), 0)) AS n, NULL AS detail FROM {}"
_ORPHANS = "SELECT count(*) AS n, NULL AS detail FROM (SELECT firm_id FROM {} EXCEPT SELECT firm_id FROM {}) AS o"
_BELOW = "SELECT count(*) AS n, NULL AS detail FROM {} WHERE employees < 1 AND NOT isnan(employees)"
_CORR = "SELECT CASE WHEN r <= 0 THEN 1 ELSE 0 END AS n, round(r, 10) AS detail FROM (SELECT corr(e.employees, t.turnover) AS r FROM employment_clean e LEFT JOIN turnover_clean t ON e.firm_id = t.firm_id AND e.month = t.month) AS c"
_RANGE = "SELECT count(*) AS n, NULL AS detail FROM panel WHERE (productivity < 0 OR productivity > 1e7) AND NOT isnan(productivity)"
_ANY = "SELECT CASE WHEN coalesce(bool_or(employees_monthly <= 0), FALSE) THEN 1 ELSE 0 END AS n, NULL AS detail FROM panel"


@_query(_with([_REGISTER, _DUPLICATED], _check("unique_keys", "firms", _UNIQUE.format("register2"))))
def check_unique_keys(spark, d):
    twice = ad.register(spark, d).select(F.when(F.col("firm_id") % 11 != 0, F.col("firm_id") - F.col("firm_id") % 3).alias("firm_id"))
    return validate.unique_keys(twice)


@_query(_with([_REGISTER, _GRID, "moved AS (SELECT firm_id + 100 AS firm_id FROM grid)"], _check("orphan_ids", "employment", _ORPHANS.format("moved", "register"))))
def check_orphan_ids(spark, d):
    return validate.orphan_ids(ad.grid(spark, d).select((F.col("firm_id") + 100).alias("firm_id")), ad.register(spark, d))


@_query(_with(_chain(), _check("employment_below_one", "employment", _BELOW.format("employment_clean"))))
def check_employment_lt_1(spark, d):
    return validate.employment_below_one(clean.clean_employment(ad.employment(spark, d)))


@_query(_with(_chain(), _check("correlation", "employment", _CORR)))
def check_correlation(spark, d):
    return _rounded(validate.correlation(clean.clean_employment(ad.employment(spark, d)), clean.clean_turnover(ad.turnover(spark, d))), detail=10)


@_query(_with(_chain(), _check("productivity_range", "panel", _RANGE)))
def check_productivity_range(spark, d):
    return validate.productivity_range(_panel(spark, d))


@_query(_with(_chain(), _check("any_nonpositive", "panel", _ANY)))
def check_any_nonpositive(spark, d):
    return validate.any_nonpositive(_panel(spark, d))


_REPORT = "\nUNION ALL\n".join(
    [
        _check("unique_keys", "firms", _UNIQUE.format("register")),
        _check("orphan_ids", "employment", _ORPHANS.format("employment_clean", "register")),
        _check("orphan_ids", "turnover", _ORPHANS.format("turnover_clean", "register")),
        _check("employment_below_one", "employment", _BELOW.format("employment_clean")),
        _check("correlation", "employment", _CORR),
        _check("productivity_range", "panel", _RANGE),
        _check("any_nonpositive", "panel", _ANY),
    ]
)


@_query(_with(_chain(), _REPORT))
def validation_report(spark, d):
    report = validate.report(ad.register(spark, d), ad.employment(spark, d), ad.turnover(spark, d), _panel(spark, d), one_row_a_month=True)
    return _rounded(report, detail=10)


@_query(
    _with(
        _chain(1),
        "SELECT round(min(x), 8) AS min, round(quantile_cont(x, 0.25), 8) AS q1, round(quantile_cont(x, 0.5), 8) AS median, round(avg(x), 8) AS mean, "
        "round(quantile_cont(x, 0.75), 8) AS q3, round(max(x), 8) AS max, CAST(count(*) - count(x) AS BIGINT) AS n_missing "
        "FROM (SELECT CASE WHEN NOT isnan(turnover_yoy) THEN turnover_yoy END AS x FROM panel) AS y",
    )
)
def six_number_summary_yoy(spark, d):
    return _rounded(na.six_number_summary(_panel(spark, d, 1), "turnover_yoy"), min=8, q1=8, median=8, mean=8, q3=8, max=8)


# ---- figures -------------------------------------------------------------------------------------------------

_SIZE = "size AS (SELECT firm_id, avg(employees_monthly) AS avg_employees FROM panel GROUP BY firm_id)"


@_query(_with([*_chain(), _SIZE], "SELECT firm_id, round(avg_employees, 8) AS avg_employees FROM size"))
def firm_size_avg(spark, d):
    return _rounded(figures.firm_size(_panel(spark, d)), avg_employees=8)


@_query(
    _with(
        [
            *_chain(),
            _SIZE,
            "b AS (SELECT min(avg_employees) AS lo0, max(avg_employees) AS hi0, (max(avg_employees) - min(avg_employees)) / 29 AS w FROM size)",
            "c AS (SELECT CAST(greatest(ceil((avg_employees - (lo0 - w / 2)) / w) - 1, 0) AS INTEGER) AS bin, count(*) AS n FROM size, b GROUP BY 1)",
        ],
        "SELECT CAST(k AS INTEGER) AS bin, round(lo0 - w / 2 + k * w, 8) AS lo, round(lo0 - w / 2 + (k + 1) * w, 8) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n FROM b, range(30) AS r(k) LEFT JOIN c ON c.bin = r.k",
    )
)
def firm_size_histogram(spark, d):
    return _rounded(figures.histogram(figures.firm_size(_panel(spark, d)), "avg_employees"), lo=8, hi=8)


@_query(_with([*_chain(1), f"cells AS ({_cells(ind.GRAINS['sector'])})"], "SELECT nace_code, avg_turnover_per_firm FROM cells WHERE year = (SELECT max(year) FROM cells)"))
def turnover_by_sector_latest_year(spark, d):
    return figures.turnover_by_sector(indicators_sector_year(spark, d))


@_query(_with([_GRID, _TURNOVER], "SELECT month, round(coalesce(sum(turnover), 0), 2) AS total_turnover FROM turnover GROUP BY month"))
def monthly_total_turnover(spark, d):
    panel = ad.turnover(spark, d).withColumnRenamed("turnover", "turnover_monthly")
    return _rounded(figures.monthly_turnover(panel), total_turnover=2)


# ---- scalars -------------------------------------------------------------------------------------------------

_FACTORS = ", ".join(f"('{k}', {m}, {float(f)!r})" for k, v in gen.SEASONALITY.items() for m, f in enumerate(v, 1))


@_query(
    "SELECT o_orderkey, CAST(f.factor AS DOUBLE) AS seasonal_factor FROM (SELECT o_orderkey, month(o_orderdate) AS m, ['G47', 'C10', 'C29', 'H49', 'I55', 'I56', 'X'][1 + o_orderkey % 7] AS code FROM orders) AS o "
    f"LEFT JOIN (VALUES {_FACTORS}) AS f(code, m, factor) ON f.code = o.code AND f.m = o.m"
)
def seasonal_factor_lookup(spark, d):
    codes = F.array(*map(F.lit, [*gen.SEASONALITY, "X"]))
    code = F.element_at(codes, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return ad._read(spark, d, "orders").select("o_orderkey", gen.seasonal_factor(code, F.month("o_orderdate")).cast("double").alias("seasonal_factor"))


@_query(
    "SELECT o_orderkey, printf('F%05d', o_custkey) AS firm, concat_ws(' ', 'Region', CAST(o_custkey % 10 AS VARCHAR)) AS region, 'Y' || CAST(year(o_orderdate) AS VARCHAR) AS label, "
    "CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(greatest(25, o_custkey % 50) AS BIGINT) AS clamped FROM orders"
)
def id_format_and_month_parts(spark, d):
    day = F.col("o_orderdate").cast("date")
    return ad._read(spark, d, "orders").select(
        "o_orderkey",
        F.format_string("F%05d", "o_custkey").alias("firm"),
        F.concat_ws(" ", F.lit("Region"), (F.col("o_custkey") % 10).cast("string")).alias("region"),
        F.concat(F.lit("Y"), F.year(day).cast("string")).alias("label"),
        F.year(day).alias("y"),
        F.month(day).alias("m"),
        F.unix_date(day).alias("days"),
        na.at_least(25, F.col("o_custkey") % 50).alias("clamped"),
    )


@_query("SELECT c_custkey AS firm_id, CAST(c_acctbal AS DOUBLE) AS revenue, CAST(c_nationkey AS DOUBLE) AS nation_number, upper(c_mktsegment) = 'BUILDING' AS building FROM customer")
def rename_drop_cast_projection(spark, d):
    df = ad._read(spark, d, "customer").withColumnRenamed("c_custkey", "firm_id").drop("c_name")
    return df.select("firm_id", F.col("c_acctbal").cast("double").alias("revenue"), F.col("c_nationkey").cast("double").alias("nation_number"), (F.upper("c_mktsegment") == "BUILDING").alias("building"))


@_query(_with([_GRID, _TURNOVER], "SELECT firm_id, month, turnover FROM turnover ORDER BY month NULLS LAST, firm_id NULLS LAST"))
def sort_nulls_last(spark, d):
    return pan.sorted_rows(ad.turnover(spark, d), "month", "firm_id")


@_query("SELECT k FROM (SELECT DISTINCT nullif(c_nationkey, 5) AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS s")
def set_difference_nulls(spark, d):
    a = ad._read(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(5)).alias("k"))
    return na.set_difference(a, ad._read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), ["k"])


# ---- keys that repeat, text that is no value ----------------------------------------------------------------

_TWICE = """e AS (SELECT c_custkey AS firm_id, DATE '1996-01-01' AS month, CAST(c_custkey % 30 AS DOUBLE) AS employees FROM customer),
t AS (SELECT firm_id, month, turnover FROM (SELECT c_custkey AS firm_id, DATE '1996-01-01' AS month, unnest(range(c_custkey % 4)) AS k, c_acctbal AS b FROM customer) AS x, (SELECT 1) AS one(o), LATERAL (SELECT b + k AS turnover) AS y),
r AS (SELECT firm_id - k AS firm_id, region_code, nace_code, employees, foundation_year, revenue_last_year FROM register, (VALUES (0), (1)) AS two(k) WHERE k = 0 OR firm_id % 5 = 0)"""


@_query(
    _with(
        [_REGISTER, _TWICE],
        "SELECT e.firm_id, e.month, e.employees AS employees_monthly, t.turnover AS turnover_monthly, r.region_code, r.nace_code, r.employees AS employees_firm, r.foundation_year, r.revenue_last_year "
        "FROM e LEFT JOIN t ON e.firm_id = t.firm_id AND e.month = t.month LEFT JOIN r ON e.firm_id = r.firm_id",
    )
)
def panel_duplicate_keys(spark, d):
    """Monthly rows of no, one, two or three matches, and a register with repeated firms: all matches are kept."""
    customer = ad._read(spark, d, "customer").select(F.col("c_custkey").alias("firm_id"), F.lit("1996-01-01").alias("month"), "c_acctbal")
    e = customer.select("firm_id", "month", (F.col("firm_id") % 30).cast("double").alias("employees"))
    times = F.when(F.col("firm_id") % 4 > 0, F.sequence(F.lit(0), (F.col("firm_id") % 4).cast("int") - 1))
    t = customer.select("firm_id", F.col("month").cast("date").alias("month"), "c_acctbal", F.explode(times).alias("k")).select("firm_id", "month", (F.col("c_acctbal") + F.col("k")).alias("turnover"))
    r = ad.register(spark, d)
    moved = r.where("firm_id % 5 = 0").withColumn("firm_id", F.col("firm_id") - 1)
    return pan.build_panel(e.withColumn("month", F.col("month").cast("date")), t, r.unionByName(moved))


_BAD = """bad AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '1996-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS month,
         CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '12 persons' WHEN 2 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS employees FROM orders)"""


@_query(_with([_BAD], "SELECT id, try_cast(month AS DATE) AS month, try_cast(employees AS DOUBLE) AS employees FROM bad"))
def cast_bad_text(spark, d):
    """Text that is no date or number is missing, not an error."""
    k = F.col("o_orderkey")
    month = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "1996-02-31").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    employees = F.when(k % 7 == 0, "NA").when(k % 7 == 1, "12 persons").when(k % 7 == 2, "").otherwise(F.col("o_custkey").cast("string"))
    return ad._read(spark, d, "orders").select(k.alias("id"), na.as_date(month).alias("month"), na.as_number(employees).alias("employees"))


# ---- generators: a firm for each customer, draws that the other engine repeats --------------------------------


def _u(name: str, *keys: str) -> str:
    return uniform_sql(gen.SEED, name, *keys)


def _choice(u: str, values: list[str]) -> str:
    return f"({values!r})[1 + CAST(floor({u} * {len(values)}) AS BIGINT)]"


def _poisson(u: str, mean: float) -> str:
    return f"len([c FOR c IN {[*poisson_table(mean)]!r} IF c < {u}])"


def _log_normal(u: str, v: str, mean: float, deviation: float) -> str:
    return f"exp({mean!r} + {deviation!r} * (sqrt(-2.0 * ln({u})) * cos({2 * math.pi!r} * {v})))"


_FIRMS = f"""firms AS (
  SELECT firm_id, {_choice(_u("region", "firm_id"), gen.REGIONS)} AS region_code, {_choice(_u("sector", "firm_id"), list(gen.SECTORS))} AS nace_code,
         {_choice(_u("form", "firm_id"), gen.LEGAL_FORMS)} AS legal_form, CAST({_poisson(_u("size", "firm_id"), 25)} + 1 AS DOUBLE) AS employees,
         CAST(floor({_u("founded", "firm_id")} * {2022 - 1965 + 1}) + 1965 AS INTEGER) AS foundation_year,
         round({_log_normal(_u("revenue", "firm_id"), _u("revenue2", "firm_id"), 12, 1)}, 2) AS revenue_last_year
  FROM (SELECT printf('F%05d', c_custkey) AS firm_id FROM customer) AS ids)"""
_MONTHS = """firm_months AS (
  SELECT firm_id, nace_code, region_code, CAST(m AS DATE) AS month FROM firms, (SELECT unnest(generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2023-12-01', INTERVAL 1 MONTH)) AS m) AS t)"""


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return ad._read(spark, d, "customer").select(F.col("c_custkey").alias("id"))


@_query(
    _with(
        [_FIRMS],
        f"SELECT firm_id, region_code, nace_code, legal_form, CASE WHEN {_u('no_size', 'firm_id')} >= 0.02 THEN employees END AS employees, foundation_year, "
        f"CASE WHEN {_u('negative', 'firm_id')} < 0.02 THEN -revenue_last_year ELSE revenue_last_year END AS revenue_last_year FROM firms",
    )
)
def gen_register(spark, d):
    return gen.register_of(_numbers(spark, d))


@_query(
    _with(
        [_FIRMS, _MONTHS, f"factors(code, m, factor) AS (VALUES {_FACTORS})"],
        "SELECT firm_id, month, nace_code, region_code, CAST(m AS INTEGER) AS month_num, CAST(factor AS DOUBLE) AS seasonal_factor, "
        f"CASE WHEN {_u('no_staff', 'firm_id', 'month')} >= 0.01 THEN round_even(greatest(1, {_poisson(_u('staff', 'firm_id', 'month'), 20)}) * CAST(factor AS DOUBLE), 0) END AS employees "
        "FROM firm_months JOIN factors ON code = nace_code AND m = month(month)",
    )
)
def gen_employment(spark, d):
    return gen.employment(gen.register_of(_numbers(spark, d), clean=True))


@_query(
    _with(
        [_FIRMS, _MONTHS],
        f"SELECT firm_id, month, nace_code, region_code, CASE WHEN {_u('no_sales', 'firm_id', 'month')} >= 0.01 "
        f"THEN round({_log_normal(_u('sales', 'firm_id', 'month'), _u('sales2', 'firm_id', 'month'), 10.5, 0.8)}, 2) END AS turnover FROM firm_months",
    )
)
def gen_turnover(spark, d):
    return gen.turnover(gen.register_of(_numbers(spark, d), clean=True))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


@_query(
    f"SELECT 'region' AS kind, code, name FROM (VALUES {_values([(r, f'Region {k}') for k, r in enumerate(gen.REGIONS, 1)])}) AS r(code, name) "
    f"UNION ALL SELECT 'sector', code, name FROM (VALUES {_values(list(gen.SECTORS.items()))}) AS s(code, name) "
    f"UNION ALL SELECT 'form', code, CAST(NULL AS VARCHAR) FROM (VALUES {', '.join(f'({x!r})' for x in gen.LEGAL_FORMS)}) AS f(code)"
)
def literal_tables(spark, d):
    parts = [
        gen.regions(spark).select(F.lit("region").alias("kind"), F.col("region_code").alias("code"), F.col("region_name").alias("name")),
        gen.sectors(spark).select(F.lit("sector").alias("kind"), F.col("nace_code").alias("code"), F.col("industry_name").alias("name")),
        gen.legal_forms(spark).select(F.lit("form").alias("kind"), F.col("legal_form").alias("code"), F.lit(None).cast("string").alias("name")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- CSV: each table as text and back ------------------------------------------------------------------------


def _round_trip(df: DataFrame, schema: str | None = None) -> DataFrame:
    return from_lines(to_lines(df), schema or ", ".join(f"{c} {t}" for c, t in df.dtypes))


@_query(_SQL["gen_register"])
def csv_round_trip_raw(spark, d):
    return _round_trip(gen_register(spark, d), SCHEMAS["firms"])


@_query(_SQL["interpolate_turnover"])
def csv_round_trip_clean(spark, d):
    return _round_trip(interpolate_turnover(spark, d))


@_query(_SQL["derive_indicators_full"])
def csv_round_trip_panel(spark, d):
    """Infinite values come back as they were, NaN as null."""
    return _round_trip(derive_indicators_full(spark, d))


@_query(_SQL["indicators_sector_region_year"])
def csv_round_trip_indicators(spark, d):
    return _round_trip(indicators_sector_region_year(spark, d))


# ---- order and labels ----------------------------------------------------------------------------------------

_ORDERED = "\nUNION ALL\n".join(
    f"SELECT '{g}' AS grain, CAST(row_number() OVER (ORDER BY {', '.join(f'{k} NULLS LAST' for k in ks)}) - 1 AS BIGINT) AS place, year, "
    + ", ".join(k if k in ks else f"CAST(NULL AS VARCHAR) AS {k}" for k in ("nace_code", "region_code"))
    + f", n_obs FROM ({_cells(ks)}) AS cells_{g}"
    for g, ks in ind.GRAINS.items()
)


@_query(_with(_chain(1), _ORDERED))
def sorted_cells(spark, d):
    """The cells of each grain in the order in which they are written, with their places in it."""
    panel = _panel(spark, d, 1)
    parts = []
    for grain, keys in ind.GRAINS.items():
        rows = pan.sorted_rows(ind.indicators(panel, keys), *keys).coalesce(1).withColumn("place", F.monotonically_increasing_id())
        codes = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("nace_code", "region_code")]
        parts.append(rows.select(F.lit(grain).alias("grain"), "place", "year", *codes, "n_obs"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ROLLED = "\nUNION ALL\n".join(
    f"SELECT '{g}' AS grain, year, {k} AS code, n_obs, n_firms, total_turnover, total_employees FROM ({_cells(ind.GRAINS[g])}) AS cells_{g}" for g, k in (("sector", "nace_code"), ("region", "region_code"))
)


@_query(_with(_chain(1), _ROLLED))
def cells_roll_up(spark, d):
    """Coarse cells as sums of the fine ones are what they are when made from the panel."""
    fine = ind.indicators(_panel(spark, d, 1), ind.GRAINS["sector_region"])
    parts = [ind.roll_up(fine, ["year", k]).select(F.lit(g).alias("grain"), "year", F.col(k).alias("code"), "n_obs", "n_firms", "total_turnover", "total_employees") for g, k in (("sector", "nace_code"), ("region", "region_code"))]
    return _rounded(parts[0].unionByName(parts[1]), total_turnover=2)


_LABELS = ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *v)) + ")" for k, v in figures.LABELS.items())


@_query(_with(_chain(1), f"SELECT figure, replace(title, '{{year}}', (SELECT CAST(max(year(month)) AS VARCHAR) FROM panel)) AS title, x_label, y_label FROM (VALUES {_LABELS}) AS l(figure, title, x_label, y_label)"))
def figure_labels(spark, d):
    return figures.labels(ad.grid(spark, d))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
