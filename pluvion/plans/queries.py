"""One query per operator, over cubes made of the driver's tables, and its SQL oracle.

Keys are returned as long and doubles rounded to six places in both engines. The numbers in
comments are the rows of the operator inventory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion import cube
from pluvion.cube import Cube
from pluvion.functions import calendar, special
from pluvion.functions.special import density_sql, phi_inverse_sql, phi_sql, t_cdf_sql
from pluvion.operators import analog, calibrate, climate, ensemble, linear, metrics, nested, regrid, seasonal, solvers, subseasonal, tercile, terrain, timing
from pluvion.sources import terciles as store
from pluvion.streaming import scoring, spells
from pluvion.streaming.places import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions that mirror the cubes.
LINES = """lines AS (SELECT year(l_shipdate) AS year, CAST(l_shipdate AS DATE) AS date, l_linenumber AS member, s_nationkey // 5 AS lat, s_nationkey % 5 AS lon,
  s_nationkey AS nation, l_quantity, l_extendedprice, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
BASE = f"""WITH {LINES},
hind AS (SELECT year, member, lat, lon, avg(l_quantity) AS value FROM lines GROUP BY ALL),
obs AS (SELECT year, lat, lon, avg(l_extendedprice) AS value FROM lines GROUP BY ALL),
hmean AS (SELECT year, lat, lon, avg(value) AS value FROM hind GROUP BY ALL),
past AS (SELECT * FROM hmean WHERE year < 2001), latest AS (SELECT lat, lon, value FROM hmean WHERE year = 2001)"""
#: Predictions with a unit of their own: the mean of members, scaled to prices by cell.
PRED = ", pred AS (SELECT h.year, h.lat, h.lon, h.value * 1500.0 AS value FROM hmean h), pair AS (SELECT p.year, p.lat, p.lon, p.value AS f, o.value AS o FROM pred p JOIN obs o USING (year, lat, lon))"
CPT = """, ranked AS (SELECT lat, lon, value, row_number() OVER (PARTITION BY lat, lon ORDER BY value) AS r, count(*) OVER (PARTITION BY lat, lon) AS n FROM obs),
cpt0 AS (SELECT lat, lon, max(n) AS n, {a} AS t33, {b} AS t67 FROM ranked GROUP BY lat, lon),
cpt AS (SELECT lat, lon, CASE WHEN n >= 3 AND t33 <> t67 THEN t33 END AS t33, CASE WHEN n >= 3 AND t33 <> t67 THEN t67 END AS t67 FROM cpt0)"""


def _at(p: float) -> str:
    pos = f"greatest(1.0, least(n * CAST({p!r} AS DOUBLE) + 0.5, CAST(n AS DOUBLE)))"
    lo, hi = f"max(CASE WHEN r = floor({pos}) THEN value END)", f"max(CASE WHEN r = least(floor({pos}) + 1, n) THEN value END)"
    return f"{lo} + max({pos} - floor({pos})) * ({hi} - {lo})"


CPT = CPT.format(a=_at(1 / 3), b=_at(2 / 3))
LIN = ", lin AS (SELECT lat, lon, quantile_cont(value, 1.0/3) AS t33, quantile_cont(value, 2.0/3) AS t67 FROM obs GROUP BY ALL)"
#: Probabilities by year: shares of members below and above the terciles of hindcast years.
PROBS = """, hlin AS (SELECT lat, lon, quantile_cont(value, 1.0/3) AS t33, quantile_cont(value, 2.0/3) AS t67 FROM hmean GROUP BY ALL),
probs0 AS (SELECT year, lat, lon, count(*) FILTER (value < t33) / CAST(count(*) AS DOUBLE) AS p_bn, count(*) FILTER (value > t67) / CAST(count(*) AS DOUBLE) AS p_an FROM hind JOIN hlin USING (lat, lon) GROUP BY ALL),
probs AS (SELECT year, lat, lon, p_bn, 1 - p_bn - p_an AS p_nn, p_an FROM probs0)"""
CAT = ", scored AS (SELECT year, lat, lon, p_bn, p_nn, p_an, o.value AS o, t33, t67, CASE WHEN t33 > o.value THEN 0 WHEN t67 > o.value THEN 1 ELSE 2 END AS was FROM probs JOIN obs o USING (year, lat, lon) JOIN cpt USING (lat, lon))"
DAILY = f"""WITH {LINES}, sums AS (SELECT nation, date, sum(l_quantity) AS q FROM lines GROUP BY ALL),
daily AS (SELECT nation, d.date, coalesce(q, 0.0) AS value FROM (SELECT DISTINCT nation FROM sums) n CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d LEFT JOIN sums USING (nation, date))"""
YEARS = range(1996, 2001)
SEASONS = DAILY + """, bounds AS (SELECT y AS year, make_date(y, 3, 1) AS start FROM (SELECT unnest(range(1996, 2001)) AS y)),
stack AS (SELECT nation, year, start, date_diff('day', start, date) AS step, value FROM daily JOIN bounds ON date BETWEEN start AND start + INTERVAL 91 DAY + INTERVAL {tail} DAY)"""


def put(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def out(df: DataFrame, keys: str = "", values: str = "") -> DataFrame:
    return df.select(*(F.col(k).cast("long").alias(k) for k in keys.split()), *((F.round(F.col(v).cast("double"), 6) + F.lit(0.0)).alias(v) for v in values.split()))


def sel(keys: str = "", values: str = "") -> str:
    return ", ".join([*(f"CAST({k} AS BIGINT) AS {k}" for k in keys.split()), *(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {v}" for v in values.split())])


def _hist(spark: SparkSession, sf: str) -> tuple[Cube, Cube]:
    """The latest year's cells, and the years before it."""
    h = cube.hindcast(spark, sf).mean("member")
    return h.over(h.df.where("year = 2001").drop("year"), ["lat", "lon"]), h.over(h.df.where("year < 2001"))


def _predicted(spark: SparkSession, sf: str) -> tuple[Cube, Cube]:
    h = cube.hindcast(spark, sf).mean("member")
    return h.over(h.df.withColumn("value", F.col("value") * 1500.0)), cube.observed(spark, sf)


def _probs(spark: SparkSession, sf: str) -> tuple[DataFrame, Cube]:
    h = cube.hindcast(spark, sf)
    return tercile.to_tercile(h, h.mean("member")), cube.observed(spark, sf)


def _positioned(method: str):
    def run(spark, sf):
        now, past = _hist(spark, sf)
        return out(climate.percentile_of(now, past, "year", method).df, "lat lon", "value")

    return run


_BELOW = "sum(CASE WHEN p.value < l.value THEN 1.0 WHEN p.value = l.value THEN 0.5 ELSE 0.0 END)"
_JOIN = "FROM latest l JOIN past p USING (lat, lon) GROUP BY l.lat, l.lon"
put("percentile_of_empirical", f"{BASE} SELECT {sel('lat lon', 'value')} FROM (SELECT l.lat, l.lon, {_BELOW} / count(*) AS value {_JOIN})")(_positioned("empirical"))  # 4.2
put("percentile_of_weibull", f"{BASE} SELECT {sel('lat lon', 'value')} FROM (SELECT l.lat, l.lon, ({_BELOW} + 0.5) / (count(*) + 1) AS value {_JOIN})")(_positioned("weibull"))  # 4.3
put("percentile_of_gaussian", f"{BASE}, z AS (SELECT l.lat, l.lon, (max(l.value) - avg(p.value)) / stddev_pop(p.value) AS z {_JOIN}) SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, {phi_sql('z')} AS value FROM z)")(_positioned("gaussian"))  # 4.4
put("percentile_of_gamma")(_positioned("gamma"))  # 4.5


@put("rank_of_record", f"{BASE} SELECT {sel('lat lon value')} FROM (SELECT l.lat, l.lon, 1 + count(*) FILTER (p.value < l.value) AS value {_JOIN})")  # 4.8
def rank_of_record(spark, sf):
    return out(climate.rank_of_record(*_hist(spark, sf), "year").df, "lat lon value")


@put("percent_of_normal", f"{BASE} SELECT {sel('lat lon', 'value')} FROM (SELECT l.lat, l.lon, 100 * max(l.value) / avg(p.value) AS value {_JOIN})")  # 4.6
def percent_of_normal(spark, sf):
    return out(climate.percent_of_normal(*_hist(spark, sf), "year").df, "lat lon", "value")


@put("frequency_below", f"{BASE}, t AS (SELECT lat, lon, quantile_cont(value, 1.0/3) AS t FROM past GROUP BY ALL) SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, avg(CASE WHEN value < t THEN 1.0 ELSE 0.0 END) AS value FROM hind JOIN t USING (lat, lon) WHERE year = 2001 GROUP BY lat, lon)")  # 4.7
def frequency_below(spark, sf):
    h, (_, past) = cube.hindcast(spark, sf), _hist(spark, sf)
    return out(climate.frequency_below(h.over(h.df.where("year = 2001").drop("year"), ["member", "lat", "lon"]), past, "year").df, "lat lon", "value")


@put("accumulate_collapse", f"{BASE} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, CASE WHEN count(value) >= (SELECT count(DISTINCT year) FROM obs) THEN sum(value) END AS value FROM obs GROUP BY ALL)")  # 4.1
def accumulate_collapse(spark, sf):
    return out(climate.accumulate(cube.observed(spark, sf), "year").df, "lat lon", "value")


@put("accumulate_rolling", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, CASE WHEN count(value) OVER w >= 3 THEN sum(value) OVER w END AS value FROM obs WINDOW w AS (PARTITION BY lat, lon ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))")  # 7.1
def accumulate_rolling(spark, sf):
    return out(climate.accumulate(cube.observed(spark, sf), "year", window=3).df, "year lat lon", "value")


@put("quantiles", f"{BASE}{LIN} SELECT {sel('lat lon', 't33 t67')} FROM lin")  # 4.9
def quantiles(spark, sf):
    return out(climate.quantiles(cube.observed(spark, sf), "year", t33=1 / 3, t67=2 / 3), "lat lon", "t33 t67")


@put("cpt_boundaries", f"{BASE}{CPT} SELECT {sel('lat lon', 't33 t67')} FROM cpt")  # 4.10
def cpt_boundaries(spark, sf):
    return out(climate.cpt_boundaries(cube.observed(spark, sf)), "lat lon", "t33 t67")


@put("prediction_error_variance", f"{BASE}{PRED} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, avg((f - o) * (f - o)) AS value FROM pair GROUP BY ALL)")  # 4.11
def prediction_error_variance(spark, sf):
    return out(climate.prediction_error_variance(*_predicted(spark, sf)).df, "lat lon", "value")


@put("error_bounds", f"{BASE}{PRED}, e AS (SELECT lat, lon, quantile_cont(f - o, 0.1) AS lo, quantile_cont(f - o, 0.9) AS hi FROM pair GROUP BY ALL) SELECT {sel('year lat lon', 'lower upper')} FROM (SELECT year, lat, lon, value - hi AS lower, value - lo AS upper FROM pred JOIN e USING (lat, lon))")  # 4.13
def error_bounds(spark, sf):
    p, o = _predicted(spark, sf)
    return out(climate.error_bounds(p, o, p), "year lat lon", "lower upper")


@put("seasonal_reduce", f"{DAILY} SELECT {sel('nation year', 'value')} FROM (SELECT nation, year(date) AS year, sum(value) AS value FROM daily WHERE month(date) IN (3, 4, 5) GROUP BY ALL)")  # 2.3
def seasonal_reduce(spark, sf):
    return out(climate.seasonal_reduce(cube.daily(spark, sf), "date", [3, 4, 5]).df, "nation year", "value")


@put("detrend", f"{BASE}, line AS (SELECT lat, lon, regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM obs GROUP BY ALL) SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, value - a - b * year AS value FROM obs JOIN line USING (lat, lon))")  # 2.11
def detrend(spark, sf):
    return out(climate.detrend(cube.observed(spark, sf)).df, "year lat lon", "value")


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct()


def _text(**columns: Column) -> list[Column]:
    return [c.cast("string").alias(n) for n, c in columns.items()]


_D = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"
_DEK, _PEN = "CAST(least((day(d) - 1) // 10, 2) AS INTEGER)", "CAST(least((day(d) - 1) // 5, 5) AS INTEGER)"
_MONTH = "CAST(date_trunc('month', d) AS DATE)"


@put("dekads", f"SELECT CAST(d AS VARCHAR) AS d, CAST({_MONTH} + {_DEK} * 10 AS VARCHAR) AS start, CAST(CASE WHEN {_DEK} = 2 THEN last_day(d) + 1 ELSE {_MONTH} + {_DEK} * 10 + 10 END AS VARCHAR) AS stop, CAST((month(d) - 1) * 3 + {_DEK} + 1 AS BIGINT) AS number FROM {_D}")  # 5.1
def dekads(spark, sf):
    d = F.col("d")
    return _dates(spark, sf).select(*_text(d=d, start=calendar.dekad_start(d), stop=calendar.dekad_end(d)), calendar.dekad_of_year(d).cast("long").alias("number"))


@put("pentads", f"SELECT CAST(d AS VARCHAR) AS d, CAST({_MONTH} + {_PEN} * 5 AS VARCHAR) AS start, CAST(CASE WHEN {_PEN} = 5 THEN last_day(d) + 1 ELSE {_MONTH} + {_PEN} * 5 + 5 END AS VARCHAR) AS stop FROM {_D}")  # 5.3
def pentads(spark, sf):
    d = F.col("d")
    return _dates(spark, sf).select(*_text(d=d, start=calendar.pentad_start(d), stop=calendar.pentad_end(d)))


@put("season_step", f"SELECT CAST(d AS VARCHAR) AS d, CAST(date_diff('day', make_date(year(d), 3, 1), d) AS BIGINT) AS daily, CAST((month(d) - 3) * 3 + {_DEK} AS BIGINT) AS dekad, CAST(month(d) - 3 AS BIGINT) AS monthly FROM {_D}")  # 5.7
def season_step(spark, sf):
    d, start = F.col("d"), F.make_date(F.year("d"), F.lit(3), F.lit(1))
    return _dates(spark, sf).select(d.cast("string").alias("d"), *(calendar.season_step(d, start, c).cast("long").alias(c) for c in ("daily", "dekad", "monthly")))


@put("infer_cadence", "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CASE WHEN g < 1.5 THEN 'daily' WHEN g < 6.5 THEN 'pentad' WHEN g < 12 THEN 'dekad' WHEN g < 45 THEN 'monthly' END AS cadence FROM (SELECT o_custkey, quantile_cont(gap, 0.5) AS g FROM (SELECT o_custkey, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)) GROUP BY ALL)")  # 5.4
def infer_cadence(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.to_date("o_orderdate").alias("d"))
    return calendar.infer_cadence(orders, "d", "o_custkey")


_Z = "(SELECT DISTINCT round(l_discount * 100 - l_tax * 50 + (l_quantity - 25) / 10, 3) AS z FROM lineitem)"


@put("normal_functions", f"SELECT {sel('', 'z cdf pdf quantile')} FROM (SELECT z, {phi_sql('z')} AS cdf, {density_sql('z')} AS pdf, {phi_inverse_sql('(abs(z) + 0.01) / 20.0')} AS quantile FROM {_Z})")  # 5.15
def normal_functions(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    z = line.select(F.round(F.col("l_discount") * 100 - F.col("l_tax") * 50 + (F.col("l_quantity") - 25) / 10, 3).alias("z")).distinct()
    return out(z.selectExpr("z", f"{phi_sql('z')} AS cdf", f"{density_sql('z')} AS pdf", f"{phi_inverse_sql('(abs(z) + 0.01) / 20.0')} AS quantile"), "", "z cdf pdf quantile")


@put("student_t", f"SELECT {sel('', 'z t5 t6')} FROM (SELECT z, {t_cdf_sql('z', 5)} AS t5, {t_cdf_sql('z', 6)} AS t6 FROM {_Z})")  # 5.16
def student_t(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    z = line.select(F.round(F.col("l_discount") * 100 - F.col("l_tax") * 50 + (F.col("l_quantity") - 25) / 10, 3).alias("z")).distinct()
    return out(z.selectExpr("z", f"{t_cdf_sql('z', 5)} AS t5", f"{t_cdf_sql('z', 6)} AS t6"), "", "z t5 t6")


@put("to_tercile_counting", f"{BASE}{PROBS} SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM probs")  # 6.1
def to_tercile_counting(spark, sf):
    return out(_probs(spark, sf)[0], "year lat lon", "p_bn p_nn p_an")


@put("to_tercile_gaussian", f"{BASE}{PROBS}, z AS (SELECT year, lat, lon, (max(t33) - avg(value)) / greatest(stddev_pop(value), 1e-12) AS a, (max(t67) - avg(value)) / greatest(stddev_pop(value), 1e-12) AS b FROM hind JOIN hlin USING (lat, lon) GROUP BY ALL) SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM (SELECT year, lat, lon, {phi_sql('a')} AS p_bn, {phi_sql('b')} - {phi_sql('a')} AS p_nn, 1 - {phi_sql('b')} AS p_an FROM z)")  # 6.2
def to_tercile_gaussian(spark, sf):
    h = cube.hindcast(spark, sf)
    return out(tercile.to_tercile(h, h.mean("member"), method="gaussian"), "year lat lon", "p_bn p_nn p_an")


_LOO = ", loo AS (SELECT a.year, a.lat, a.lon, a.f, quantile_cont(b.o, 1.0/3) AS t33, quantile_cont(b.o, 2.0/3) AS t67, avg((b.f - b.o) * (b.f - b.o)) AS pev FROM pair a JOIN pair b ON a.lat = b.lat AND a.lon = b.lon AND a.year <> b.year GROUP BY ALL)"


def _law(kind: str, body: str) -> str:
    f = {"n": phi_sql, "t": lambda z: t_cdf_sql(z, 7), "c": lambda z: t_cdf_sql(z, 5)}[kind]
    return f"{BASE}{PRED}{_LOO}{LIN}{CPT}, z AS ({body}) SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM (SELECT year, lat, lon, {f('za')} AS p_bn, {f('zb')} - {f('za')} AS p_nn, 1 - {f('zb')} AS p_an FROM z)"


_PEV = "(SELECT lat, lon, avg((f - o) * (f - o)) AS pev FROM pair GROUP BY ALL)"
_FULL = f"SELECT year, lat, lon, (t33 - f) / sqrt(pev * 5.0 / 7.0) AS za, (t67 - f) / sqrt(pev * 5.0 / 7.0) AS zb FROM pair JOIN lin USING (lat, lon) JOIN {_PEV} USING (lat, lon)"
_CV = {
    "bootstrap": f"{BASE}{PRED}{_LOO}, d AS (SELECT l.year, l.lat, l.lon, l.f - (p.f - p.o) AS x, t33, t67 FROM loo l JOIN pair p ON l.lat = p.lat AND l.lon = p.lon AND l.year <> p.year), s AS (SELECT year, lat, lon, count(*) FILTER (x < t33) / CAST(count(*) AS DOUBLE) AS p_bn, count(*) FILTER (x > t67) / CAST(count(*) AS DOUBLE) AS p_an FROM d GROUP BY ALL) SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM (SELECT *, 1 - p_bn - p_an AS p_nn FROM s)",
    "gaussian_loo": _law("n", "SELECT year, lat, lon, (t33 - f) / greatest(sqrt(pev), 1e-12) AS za, (t67 - f) / greatest(sqrt(pev), 1e-12) AS zb FROM loo"),
    "gaussian_pev": _law("n", _FULL), "t": _law("t", _FULL),
    "cpt": _law("c", f"SELECT year, lat, lon, (t33 - f) / sqrt(pev * 7.0 / 5.0) AS za, (t67 - f) / sqrt(pev * 7.0 / 5.0) AS zb FROM pair JOIN cpt USING (lat, lon) JOIN {_PEV} USING (lat, lon)"),
}
for _m, _sql in _CV.items():  # 6.3 to 6.7
    put(f"to_tercile_cv_{_m}", _sql)(lambda spark, sf, m=_m: out(tercile.to_tercile_cv(*_predicted(spark, sf), method=m, n_years=7), "year lat lon", "p_bn p_nn p_an"))


@put("tercile_labels", f"{BASE}{LIN} SELECT {sel('year lat lon category')} FROM (SELECT year, lat, lon, CASE WHEN value < t33 THEN 0 WHEN value > t67 THEN 2 ELSE 1 END AS category FROM obs JOIN lin USING (lat, lon))")  # 6.8
def tercile_labels(spark, sf):
    return out(tercile.labels(cube.observed(spark, sf)), "year lat lon category")


_GAPPY = ", a AS (SELECT year, lat, lon, CASE WHEN year <> 1997 THEN p_bn END AS p_bn, p_nn, p_an FROM probs), b AS (SELECT year, lat, lon, 1.0/3 AS p_bn, 1.0/3 AS p_nn, 1.0/3 AS p_an FROM probs WHERE lat > 0)"


def _combined(missing: str):
    def run(spark, sf):
        p, _ = _probs(spark, sf)
        a = p.withColumn("p_bn", F.when(F.col("year") != 1997, F.col("p_bn")))
        b = p.where("lat > 0").select("year", "lat", "lon", *(F.lit(1 / 3).alias(c) for c in tercile.P))
        return out(tercile.combine([(a, 2.0), (b, 1.0)], ["year", "lat", "lon"], missing), "year lat lon", "p_bn p_nn p_an")

    return run


def _combine_sql(missing: str) -> str:
    rows = "SELECT year, lat, lon, p_bn, p_nn, p_an, CASE WHEN p_bn IS NOT NULL AND p_nn IS NOT NULL AND p_an IS NOT NULL THEN w END AS w FROM (SELECT *, 2.0 AS w FROM a UNION ALL BY NAME SELECT *, 1.0 AS w FROM b)"
    mean = {"drop": "sum(w * {p}) / sum(w)", "climatology": "(sum(w * {p}) + (3.0 - sum(w)) / 3) / 3.0"}[missing]
    return f"{BASE}{PROBS}{_GAPPY} SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM (SELECT year, lat, lon, {', '.join(mean.format(p=p) + ' AS ' + p for p in tercile.P)} FROM ({rows}) GROUP BY year, lat, lon)"


for _m in ("drop", "climatology"):  # 6.12
    put(f"combine_terciles_{_m}", _combine_sql(_m))(_combined(_m))


@put("mask_by_skill", f"{BASE}{PRED}, s AS (SELECT lat, lon, corr(f, o) AS skill FROM pair GROUP BY ALL) SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, CASE WHEN skill > 0.1 THEN value END AS value FROM pred JOIN s USING (lat, lon))")  # 2.8
def mask_by_skill(spark, sf):
    p, o = _predicted(spark, sf)
    skill = metrics.pearson_r(p, o, spatial=True).withColumnRenamed("value", "skill")
    return out(tercile.mask_by_skill(p.df, skill, ["lat", "lon"], ["value"], 0.1), "year lat lon", "value")


@put("flex_forecast", f"{BASE}{PRED}, q AS (SELECT lat, lon, quantile_cont(value, 0.8) AS t FROM obs GROUP BY ALL), z AS (SELECT year, lat, lon, (t - f) / sqrt(pev) AS z FROM pair JOIN q USING (lat, lon) JOIN {_PEV} USING (lat, lon)) SELECT {sel('year lat lon', 'p_exceed')} FROM (SELECT year, lat, lon, 1 - {phi_sql('z')} AS p_exceed FROM z)")  # 6.13
def flex_forecast(spark, sf):
    p, o = _predicted(spark, sf)
    pev = climate.prediction_error_variance(p, o).df.withColumnRenamed("value", "pev")
    return out(tercile.flex(p.df.join(pev, ["lat", "lon"]), ["year", "lat", "lon"], o, 0.8), "year lat lon", "p_exceed")


@put("write_terciles", f"{BASE}{PROBS} SELECT {sel('year lat lon', 'below normal above')} FROM (SELECT year, lat, lon, CAST(p_bn / (p_bn + p_nn + p_an) * 100 AS FLOAT) AS below, CAST(p_nn / (p_bn + p_nn + p_an) * 100 AS FLOAT) AS normal, CAST(p_an / (p_bn + p_nn + p_an) * 100 AS FLOAT) AS above FROM probs)")  # 1.2
def write_terciles(spark, sf):
    return out(store.to_percent(_probs(spark, sf)[0]), "year lat lon", "below normal above")


_STEPS = {
    "pearson_r": "SELECT avg(v) AS value FROM (SELECT corr(f, o) AS v FROM pair GROUP BY lat, lon)",
    "spearman": "SELECT avg(v) AS value FROM (SELECT corr(rf, ro) AS v FROM (SELECT lat, lon, rank() OVER (PARTITION BY lat, lon ORDER BY f) + (count(*) OVER (PARTITION BY lat, lon, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY lat, lon ORDER BY o) + (count(*) OVER (PARTITION BY lat, lon, o) - 1) / 2.0 AS ro FROM pair) GROUP BY lat, lon)",
    "two_afc": "SELECT avg(v) AS value FROM (SELECT avg(CASE WHEN a.f < b.f THEN 1.0 WHEN a.f = b.f THEN 0.5 ELSE 0.0 END) AS v FROM pair a JOIN pair b ON a.lat = b.lat AND a.lon = b.lon AND a.o < b.o GROUP BY a.lat, a.lon)",
    "rmse": "SELECT avg(v) AS value FROM (SELECT sqrt(avg((f - o) * (f - o))) AS v FROM pair GROUP BY lat, lon)",
    "msss": "SELECT 1 - avg(e) / avg(v) AS value FROM (SELECT avg((f - o) * (f - o)) AS e, var_pop(o) AS v FROM pair GROUP BY lat, lon)",
}
for _m, _sql in _STEPS.items():  # 9.5 to 9.9
    put(f"{_m}_pooled", f"{BASE}{PRED}, r AS ({_sql}) SELECT {sel('', 'value')} FROM r")(lambda spark, sf, m=_m: out(metrics.get_metric({"two_afc": "2afc"}.get(m, m))(*_predicted(spark, sf)), "", "value"))
put("rmse_spatial", f"{BASE}{PRED} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, sqrt(avg((f - o) * (f - o))) AS value FROM pair GROUP BY lat, lon)")(lambda spark, sf: out(metrics.rmse(*_predicted(spark, sf), spatial=True), "lat lon", "value"))
put("pearson_spatial", f"{BASE}{PRED} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, corr(f, o) AS value FROM pair GROUP BY lat, lon)")(lambda spark, sf: out(metrics.pearson_r(*_predicted(spark, sf), spatial=True), "lat lon", "value"))

_RPS = "avg((power(p_bn - y1, 2) + power(p_bn + p_nn - y2, 2)) / 2) AS s, avg((power(1.0/3 - y1, 2) + power(2.0/3 - y2, 2)) / 2) AS c FROM (SELECT *, CASE WHEN t33 > o THEN 1.0 ELSE 0.0 END AS y1, CASE WHEN t67 > o THEN 1.0 ELSE 0.0 END AS y2 FROM scored)"
_SC = BASE + PROBS + CPT + CAT
put("rpss_pooled", f"{_SC} SELECT {sel('', 'value')} FROM (SELECT CASE WHEN c > 0 THEN 1 - s / c ELSE 0 END AS value FROM (SELECT {_RPS}))")(lambda spark, sf: out(metrics.rpss(*_probs(spark, sf)), "", "value"))  # 9.1
put("rpss_spatial", f"{_SC} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, CASE WHEN c > 0 THEN 1 - s / c ELSE 0 END AS value FROM (SELECT lat, lon, {_RPS} GROUP BY lat, lon))")(lambda spark, sf: out(metrics.rpss(*_probs(spark, sf), spatial=True), "lat lon", "value"))
_TOLD = ", told AS (SELECT was, CASE WHEN p_bn >= p_nn AND p_bn >= p_an THEN 0 WHEN p_nn >= p_an THEN 1 ELSE 2 END AS said FROM scored)"
put("hss", f"{_SC}{_TOLD} SELECT {sel('', 'value')} FROM (SELECT (h - e) / (n - e) AS value FROM (SELECT sum(CASE WHEN said = was THEN c ELSE 0 END) AS h, sum(c) AS n, sum(CASE WHEN said = was THEN ns * nw / total END) AS e FROM (SELECT k.said, k.was, coalesce(t.c, 0) AS c, (SELECT count(*) FROM told x WHERE x.said = k.said) AS ns, (SELECT count(*) FROM told x WHERE x.was = k.was) AS nw, (SELECT count(*) FROM told) AS total FROM (SELECT a.i AS said, b.i AS was FROM range(3) a(i), range(3) b(i)) k LEFT JOIN (SELECT said, was, count(*) AS c FROM told GROUP BY ALL) t USING (said, was))))")(lambda spark, sf: out(metrics.hss(*_probs(spark, sf)), "", "value"))  # 9.11
_LONG = ", long AS (SELECT was, 0 AS tercile, p_bn AS p FROM scored UNION ALL SELECT was, 1, p_nn FROM scored UNION ALL SELECT was, 2, p_an FROM scored)"
_AREA = ", pos AS (SELECT tercile, p FROM long WHERE was = tercile), neg AS (SELECT tercile, p FROM long WHERE was <> tercile), auc AS (SELECT pos.tercile, avg(CASE WHEN pos.p > neg.p THEN 1.0 WHEN pos.p = neg.p THEN 0.5 ELSE 0.0 END) AS value FROM pos JOIN neg USING (tercile) GROUP BY ALL)"
put("roc_areas", f"{_SC}{_LONG}{_AREA} SELECT CASE tercile WHEN 0 THEN 'roc_bn' WHEN 1 THEN 'roc_nn' ELSE 'roc_an' END AS metric, {sel('', 'value')} FROM auc")(lambda spark, sf: metrics.roc(*_probs(spark, sf)).select("metric", (F.round("value", 6) + 0.0).alias("value")))  # 9.2
put("generalized_roc", f"{_SC}{_LONG} SELECT {sel('', 'value')} FROM (SELECT avg(value) AS value FROM (SELECT a.tercile, b.was, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS value FROM long a JOIN long b ON b.tercile = a.tercile AND a.was = a.tercile AND b.was <> a.was GROUP BY ALL))")(lambda spark, sf: out(metrics.generalized_roc(*_probs(spark, sf)), "", "value"))  # 9.4
_DIAGRAM = ", diagram AS (SELECT tercile, (CASE WHEN p >= 0.2 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.4 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.6 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.8 THEN 1 ELSE 0 END) AS bin, avg(p) AS mean_prob, avg(CASE WHEN was = tercile THEN 1.0 ELSE 0.0 END) AS obs_freq, count(*) AS n FROM long GROUP BY ALL)"
put("reliability_diagram", f"{_SC}{_LONG}{_DIAGRAM} SELECT {sel('tercile bin n', 'mean_prob obs_freq')} FROM diagram")(lambda spark, sf: out(metrics.reliability_diagram(*_probs(spark, sf)), "tercile bin n", "mean_prob obs_freq"))  # 9.12
put("reliability", f"{_SC}{_LONG}{_DIAGRAM} SELECT {sel('', 'value')} FROM (SELECT sum(n * power(mean_prob - obs_freq, 2)) / sum(n) AS value FROM diagram)")(lambda spark, sf: out(metrics.reliability(*_probs(spark, sf)), "", "value"))
_SPREAD = BASE + ", se AS (SELECT h.year, h.lat, h.lon, stddev_pop(h.value) AS spread, abs(avg(h.value) - max(o.value) / 1500.0) AS error FROM hind h JOIN obs o USING (year, lat, lon) GROUP BY ALL)"


def _scaled(spark, sf) -> tuple[Cube, Cube]:
    o = cube.observed(spark, sf)
    return cube.hindcast(spark, sf), o.over(o.df.withColumn("value", F.col("value") / 1500.0))


put("spread_error_ratio", f"{_SPREAD} SELECT {sel('', 'value')} FROM (SELECT avg(spread) / avg(error) AS value FROM se)")(lambda spark, sf: out(metrics.spread_error_ratio(*_scaled(spark, sf)), "", "value"))  # 9.13
put("spread_error_correlation", f"{_SPREAD} SELECT {sel('', 'value')} FROM (SELECT corr(s, e) AS value FROM (SELECT year, avg(spread) AS s, avg(error) AS e FROM se GROUP BY year))")(lambda spark, sf: out(metrics.spread_error_correlation(*_scaled(spark, sf)), "", "value"))  # 9.14
_CRPS = "{s} * ({z} * (2 * {phi} - 1) + 2 * {d} - 0.5641895835477563)"
put(
    "crpss",
    f"{BASE}, g AS (SELECT year, lat, lon, avg(value) AS mu, greatest(stddev_pop(value), 1e-12) AS sigma FROM hind GROUP BY ALL), c AS (SELECT stddev_pop(value / 1500.0) AS sd FROM obs), z AS (SELECT sigma, sd, (o.value / 1500.0 - mu) / sigma AS z, o.value / 1500.0 / sd AS zc FROM g JOIN obs o USING (year, lat, lon) CROSS JOIN c) "
    f"SELECT {sel('', 'value')} FROM (SELECT 1 - avg({_CRPS.format(s='sigma', z='z', phi=phi_sql('z'), d=density_sql('z'))}) / avg({_CRPS.format(s='sd', z='zc', phi=phi_sql('zc'), d=density_sql('zc'))}) AS value FROM z)",
)(lambda spark, sf: out(metrics.crpss((h := _scaled(spark, sf))[0].df.groupBy("year", "lat", "lon").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma")), h[1]), "", "value"))  # 9.10


@put("fdr", f"{BASE}{PRED}, p AS (SELECT lat, lon, 1 - abs(corr(f, o)) AS p FROM pair GROUP BY ALL), r AS (SELECT lat, lon, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) SELECT {sel('lat lon', 'p q')} FROM (SELECT lat, lon, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS q FROM r)")  # 9.17
def fdr(spark, sf):
    r = metrics.pearson_r(*_predicted(spark, sf), spatial=True)
    return out(metrics.fdr(r.select("lat", "lon", (1 - F.abs("value")).alias("p"))), "lat lon", "p q")


_PRESS = f"{BASE}{PRED}, s AS (SELECT *, avg(f) OVER w AS mf, avg(o) OVER w AS mo, count(*) OVER w AS n FROM pair WINDOW w AS (PARTITION BY lat, lon)), x AS (SELECT *, sum((f - mf) * (f - mf)) OVER w AS xx, sum((f - mf) * (o - mo)) OVER w AS xy FROM s WINDOW w AS (PARTITION BY lat, lon)), h AS (SELECT *, 1.0 / n + (f - mf) * (f - mf) / xx AS leverage FROM x) SELECT {sel('year lat lon', 'leverage loo')} FROM (SELECT year, lat, lon, leverage, o - (o - (mo + xy / xx * (f - mf))) / (1 - leverage) AS loo FROM h)"
put("loo_predict", _PRESS)(lambda spark, sf: out(metrics.loo(*_predicted(spark, sf)), "year lat lon", "leverage loo"))  # 7.15


def _seasons(spark, sf, tail: int = 0) -> Cube:
    return climate.seasonal_stack(cube.daily(spark, sf), "date", (3, 5), list(YEARS), tail_days=tail)


@put("seasonal_stack", SEASONS.format(tail=0) + f" SELECT {sel('nation year step', 'value')} FROM stack")  # 2.2
def seasonal_stack(spark, sf):
    return out(_seasons(spark, sf).df, "nation year step", "value")


_RUNS = ", wet AS (SELECT *, max(CASE WHEN value > 5 THEN step END) OVER (PARTITION BY nation, year ORDER BY step) AS last FROM stack), runs AS (SELECT *, step - coalesce(last, -1) AS run FROM wet)"
put("dry_runs", SEASONS.format(tail=0) + _RUNS + f" SELECT {sel('nation year step run')} FROM runs")(lambda spark, sf: out(timing.dry_runs(_seasons(spark, sf), "step", 5.0), "nation year step run"))  # 7.3
put("rolling_total", SEASONS.format(tail=0) + f" SELECT {sel('nation year step', 'total')} FROM (SELECT nation, year, step, CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END AS total FROM stack WINDOW w AS (PARTITION BY nation, year ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))")(lambda spark, sf: out(timing.rolling_total(_seasons(spark, sf), "step", 3), "nation year step", "total"))  # 7.2
put("dry_spell", SEASONS.format(tail=0) + _RUNS + f" SELECT {sel('nation year', 'longest count')} FROM (SELECT nation, year, max(run) AS longest, count(*) FILTER (run = 4) AS count FROM runs GROUP BY ALL)")(lambda spark, sf: out(timing.dry_spell(_seasons(spark, sf), 5.0, 4), "nation year", "longest count"))  # 7.8

_ONSET = SEASONS.format(tail=12) + _RUNS + """, tri AS (SELECT *, CASE WHEN count(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS total,
 max(run) OVER (w ROWS BETWEEN 6 FOLLOWING AND 12 FOLLOWING) AS worst, count(value) OVER (w ROWS BETWEEN 3 FOLLOWING AND 12 FOLLOWING) AS seen FROM runs WINDOW w AS (PARTITION BY nation, year ORDER BY step)),
onset AS (SELECT nation, year, min(step) FILTER (total >= 60 AND seen = 10 AND coalesce(worst, 0) < 4 AND step BETWEEN 0 AND 91) AS step FROM tri GROUP BY ALL)"""
_ON = {"accum": 60.0, "accum_days": 3, "dry_threshold": 5.0, "dry_days": 4, "guard_days": 10, "season_steps": 92}
put("onset", _ONSET + f" SELECT {sel('nation year', 'step occurred')} FROM (SELECT nation, year, step, CASE WHEN step IS NULL THEN 0.0 ELSE 1.0 END AS occurred FROM onset)")(lambda spark, sf: out(timing.onset(_seasons(spark, sf, 12), **_ON), "nation year", "step occurred"))  # 7.5
_CEASE = ", ends AS (SELECT nation, year, step, lead(run, 3) OVER (PARTITION BY nation, year ORDER BY step) AS ahead FROM runs), cease AS (SELECT e.nation, e.year, min(e.step) FILTER (ahead >= 4 AND e.step >= o.step) AS step FROM ends e JOIN onset o USING (nation, year) GROUP BY ALL)"


def _timed(spark, sf):
    s = _seasons(spark, sf, 12)
    first = timing.onset(s, **_ON)
    return first, timing.cessation(s, first, 5.0, 4, 92)


put("cessation", _ONSET + _CEASE + f" SELECT {sel('nation year', 'step occurred')} FROM (SELECT nation, year, step, CASE WHEN step IS NULL THEN 0.0 ELSE 1.0 END AS occurred FROM cease)")(lambda spark, sf: out(_timed(spark, sf)[1], "nation year", "step occurred"))  # 7.6
put("season_length", _ONSET + _CEASE + f" SELECT {sel('nation year', 'length')} FROM (SELECT nation, year, c.step - o.step AS length FROM onset o JOIN cease c USING (nation, year))")(lambda spark, sf: out(timing.season_length(*_timed(spark, sf), "nation", "year"), "nation year", "length"))  # 7.7


def _fine(n: int) -> list[float]:
    return [i / 2 for i in range(2 * n - 1)]


_AX = "(SELECT t, CAST(floor(t) AS BIGINT) AS lo, CAST(ceil(t) AS BIGINT) AS hi, t - floor(t) AS w FROM (SELECT i / 2.0 AS t FROM range(0, 9) r(i)))"
put("regrid_linear", f"""{BASE} SELECT CAST(year AS BIGINT) AS year, {sel('', 'lat lon value')} FROM (SELECT y.year, a.t AS lat, b.t AS lon,
 (1 - a.w) * (1 - b.w) * o00.value + (1 - a.w) * b.w * o01.value + a.w * (1 - b.w) * o10.value + a.w * b.w * o11.value AS value FROM (SELECT DISTINCT year FROM obs) y CROSS JOIN {_AX} a CROSS JOIN {_AX} b
 LEFT JOIN obs o00 ON o00.year = y.year AND o00.lat = a.lo AND o00.lon = b.lo LEFT JOIN obs o01 ON o01.year = y.year AND o01.lat = a.lo AND o01.lon = b.hi
 LEFT JOIN obs o10 ON o10.year = y.year AND o10.lat = a.hi AND o10.lon = b.lo LEFT JOIN obs o11 ON o11.year = y.year AND o11.lat = a.hi AND o11.lon = b.hi)""")(lambda spark, sf: out(regrid.linear(cube.observed(spark, sf), _fine(5), _fine(5)).df, "year", "lat lon value"))  # 5.9
put("coarsen", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat // 2 AS lat, lon // 2 AS lon, avg(value) AS value FROM obs GROUP BY ALL HAVING count(*) = 4)")(lambda spark, sf: out(regrid.coarsen(cube.observed(spark, sf), 2).df, "year lat lon", "value"))  # 4.17

put("climatology", f"{BASE} SELECT {sel('lat lon', 'value')} FROM (SELECT lat, lon, avg(value) AS value FROM obs GROUP BY ALL)")(lambda spark, sf: out(calibrate.climatology(cube.observed(spark, sf)).df, "lat lon", "value"))  # 11.1


def _split(spark, sf):
    h = cube.hindcast(spark, sf)
    return h.over(h.df.where("year = 2001").drop("year"), ["member", "lat", "lon"]), h.over(h.df.where("year < 2001")), cube.observed(spark, sf)


_DELTA = "SELECT h.member, h.lat, h.lon, o.m + h.value - c.m AS value FROM hind h JOIN (SELECT lat, lon, avg(value) AS m FROM obs GROUP BY ALL) o USING (lat, lon) JOIN (SELECT lat, lon, avg(value) AS m FROM hind WHERE year < 2001 GROUP BY ALL) c USING (lat, lon) WHERE h.year = 2001"
put("delta", f"{BASE}, d AS ({_DELTA}) SELECT {sel('member lat lon', 'value')} FROM d")(lambda spark, sf: out(calibrate.delta(*_split(spark, sf)).df, "member lat lon", "value"))  # 11.2
_QP = "SELECT h.member, h.lat, h.lon, t.m + (h.value - s.m) / CASE WHEN s.d < 1e-12 THEN 1 ELSE s.d END * t.d AS value FROM hind h JOIN (SELECT lat, lon, avg(value) AS m, stddev_samp(value) AS d FROM past GROUP BY ALL) s USING (lat, lon) JOIN (SELECT lat, lon, avg(value) AS m, stddev_samp(value) AS d FROM obs GROUP BY ALL) t USING (lat, lon) WHERE h.year = 2001"
put("quantile_map_parametric", f"{BASE}, d AS ({_QP}) SELECT {sel('member lat lon', 'value')} FROM d")(lambda spark, sf: out(calibrate.quantile_map((x := _split(spark, sf))[0], x[1].mean("member"), x[2], variant="parametric").df, "member lat lon", "value"))  # 5.13, 11.4
_QE = """, sv AS (SELECT lat, lon, value AS x, (row_number() OVER (PARTITION BY lat, lon ORDER BY value) - 0.5) / count(*) OVER (PARTITION BY lat, lon) AS p FROM past),
tv AS (SELECT lat, lon, value AS x, (row_number() OVER (PARTITION BY lat, lon ORDER BY value) - 0.5) / count(*) OVER (PARTITION BY lat, lon) AS p FROM obs),
v AS (SELECT member, lat, lon, value FROM hind WHERE year = 2001),
b AS (SELECT v.member, v.lat, v.lon, v.value, max(CASE WHEN x <= v.value THEN x END) AS x0, min(CASE WHEN x > v.value THEN x END) AS x1, max(CASE WHEN x <= v.value THEN p END) AS p0, min(CASE WHEN x > v.value THEN p END) AS p1 FROM v JOIN sv USING (lat, lon) GROUP BY ALL),
q AS (SELECT member, lat, lon, CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL THEN p0 ELSE p0 + (value - x0) / (x1 - x0) * (p1 - p0) END AS q FROM b),
c AS (SELECT q.member, q.lat, q.lon, q.q, max(CASE WHEN p <= q.q THEN x END) AS x0, min(CASE WHEN p > q.q THEN x END) AS x1, max(CASE WHEN p <= q.q THEN p END) AS p0, min(CASE WHEN p > q.q THEN p END) AS p1 FROM q JOIN tv USING (lat, lon) GROUP BY ALL)"""
put("quantile_map_empirical", f"{BASE}{_QE} SELECT {sel('member lat lon', 'value')} FROM (SELECT member, lat, lon, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (q - p0) / (p1 - p0) * (x1 - x0) END AS value FROM c)")(lambda spark, sf: out(calibrate.quantile_map((x := _split(spark, sf))[0], x[1].mean("member"), x[2]).df, "member lat lon", "value"))  # 5.12, 11.4

_EREG = """, hp AS (SELECT h.lat, h.lon, h.value AS x, o.value AS y FROM past h JOIN obs o USING (year, lat, lon)),
r AS (SELECT lat, lon, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) / (count(*) - 2) AS pev FROM hp GROUP BY ALL),
m AS (SELECT lat, lon, a + b * value AS mu, sqrt(pev * (1 + 1.0 / n + power(value - mx, 2) / sxx)) AS sigma FROM latest JOIN r USING (lat, lon)),
z AS (SELECT lat, lon, mu, sigma, (t33 - mu) / sigma AS za, (t67 - mu) / sigma AS zb FROM m JOIN lin USING (lat, lon))"""
put("ereg_tercile", f"{BASE}{LIN}{_EREG} SELECT {sel('lat lon', 'mu sigma p_bn p_nn p_an')} FROM (SELECT lat, lon, mu, sigma, {phi_sql('za')} AS p_bn, {phi_sql('zb')} - {phi_sql('za')} AS p_nn, 1 - {phi_sql('zb')} AS p_an FROM z)")(lambda spark, sf: out(calibrate.ereg((x := _split(spark, sf))[0], x[1], x[2]), "lat lon", "mu sigma p_bn p_nn p_an"))  # 11.13
_ELOYO = """, hp AS (SELECT h.year, h.lat, h.lon, h.value AS x, o.value AS y FROM hmean h JOIN obs o USING (year, lat, lon)),
r AS (SELECT a.year, a.lat, a.lon, a.x, count(*) AS n, avg(b.x) AS mx, regr_sxx(b.y, b.x) AS sxx, regr_slope(b.y, b.x) AS b, regr_intercept(b.y, b.x) AS a, (regr_syy(b.y, b.x) - regr_slope(b.y, b.x) * regr_slope(b.y, b.x) * regr_sxx(b.y, b.x)) / (count(*) - 2) AS pev, quantile_cont(b.y, 1.0/3) AS t33, quantile_cont(b.y, 2.0/3) AS t67 FROM hp a JOIN hp b ON a.lat = b.lat AND a.lon = b.lon AND a.year <> b.year GROUP BY a.year, a.lat, a.lon, a.x),
m AS (SELECT *, a + b * x AS mu, sqrt(pev * (1 + 1.0 / n + power(x - mx, 2) / sxx)) AS sigma FROM r), z AS (SELECT *, (t33 - mu) / sigma AS za, (t67 - mu) / sigma AS zb FROM m)"""
put("ereg_loyo", f"{BASE}{_ELOYO} SELECT {sel('year lat lon', 'p_bn p_nn p_an')} FROM (SELECT year, lat, lon, {phi_sql('za')} AS p_bn, {phi_sql('zb')} - {phi_sql('za')} AS p_nn, 1 - {phi_sql('zb')} AS p_an FROM z)")(lambda spark, sf: out(calibrate.ereg_loyo(cube.hindcast(spark, sf), cube.observed(spark, sf)), "year lat lon", "p_bn p_nn p_an"))  # 10.14
_Y7 = "(SELECT unnest(range(1995, 2002)) AS y)"
_YL = "(SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)"


def _years_of(spark, sf) -> list[int]:
    """The years that anything was shipped in: a few."""
    return sorted(r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select(F.year("l_shipdate")).distinct().collect())


put("loyo_folds", f"SELECT CAST(t.y - 1995 AS BIGINT) AS fold, CAST(t.y AS BIGINT) AS year, 'test' AS role FROM {_YL} t UNION ALL SELECT t.y - 1995, x.y, 'train' FROM {_YL} t, {_YL} x WHERE abs(t.y - x.y) > 1")(lambda spark, sf: calibrate.folds(spark, _years_of(spark, sf), "loyo", window=3).selectExpr("CAST(fold AS BIGINT) AS fold", "CAST(year AS BIGINT) AS year", "role"))  # 10.13


def _models(spark, sf) -> DataFrame:
    h = cube.hindcast(spark, sf).df.where("member <= 3")
    return h.select(F.concat(F.lit("m"), F.col("member")).alias("model"), "year", "lat", "lon", "value")


_SKILL = {"m1": 0.4, "m2": 0.1, "m3": -0.2}


def _skill(spark) -> DataFrame:
    return spark.createDataFrame(list(_SKILL.items()), "model string, skill double")


_K = ["year", "lat", "lon"]
put("ensemble_uniform", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, CASE WHEN count(*) = 3 THEN avg(value) END AS value FROM hind WHERE member <= 3 GROUP BY ALL)")(lambda spark, sf: out(ensemble.uniform(_models(spark, sf), _K), "year lat lon", "value"))  # 10.1
put("ensemble_skill_weighted", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, sum(value * CASE member WHEN 1 THEN 0.8 WHEN 2 THEN 0.2 ELSE 0.0 END) AS value FROM hind WHERE member <= 3 GROUP BY ALL)")(lambda spark, sf: out(ensemble.skill_weighted(_models(spark, sf), _K, _skill(spark)), "year lat lon", "value"))  # 10.2
put("ensemble_drop_worst", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, avg(value) AS value FROM hind WHERE member <= 2 GROUP BY ALL)")(lambda spark, sf: out(ensemble.drop_worst(_models(spark, sf), _K, _skill(spark)), "year lat lon", "value"))  # 10.3
put("ensemble_bma")(lambda spark, sf: out(ensemble.bma(_models(spark, sf), _K, (o := cube.observed(spark, sf)).df.withColumn("value", F.col("value") / 1500.0))[0], "year lat lon", "value"))  # 10.4
put("pool_ensembles", f"{BASE} SELECT {sel('year lat lon member', 'value')} FROM (SELECT year, lat, lon, member - 1 AS member, value FROM hind WHERE member <= 3)")(lambda spark, sf: out(ensemble.pool(_models(spark, sf).withColumn("member", F.lit(0)), _K), "year lat lon member", "value"))  # 8.7

_IDX = f"{BASE}, m AS (SELECT year, avg(CASE WHEN lat BETWEEN 0 AND 2 AND lon BETWEEN 0 AND 2 THEN value END) AS west, avg(CASE WHEN lat BETWEEN 0 AND 4 AND lon BETWEEN 2 AND 4 THEN value END) AS east FROM hind GROUP BY year), s AS (SELECT avg(west) AS mw, stddev_pop(west) AS sw, avg(east) AS me, stddev_pop(east) AS se FROM m), idx AS (SELECT year, (west - mw) / sw - (east - me) / se AS value FROM m CROSS JOIN s)"


def _index(spark, sf) -> DataFrame:
    two = analog.Index("dipole", {"west": (0, 2, 0, 2), "east": (0, 4, 2, 4)}, lambda a, b: a - b, "standardize")
    return two.reduce(cube.hindcast(spark, sf))


put("index_reduce", f"{_IDX} SELECT {sel('year', 'value')} FROM idx")(lambda spark, sf: out(_index(spark, sf), "year", "value"))  # 12.3
_RANKED = "SELECT year, score, CASE WHEN row_number() OVER (ORDER BY score, year) <= 3 THEN row_number() OVER (ORDER BY score, year) END AS rank FROM s2"
put("analogs_from_index", f"{_IDX}, s2 AS (SELECT year, abs(value - 0.5) AS score FROM idx) SELECT {sel('year rank', 'score')} FROM ({_RANKED})")(lambda spark, sf: out(analog.analogs_from_index(_index(spark, sf), 0.5, 3), "year rank", "score"))  # 12.6
put("analogs_from_field", f"{BASE}, s2 AS (SELECT p.year, sqrt(sum(cos(radians(p.lat)) * (p.value - l.value) * (p.value - l.value)) / sum(cos(radians(p.lat)))) AS score FROM past p JOIN latest l USING (lat, lon) GROUP BY p.year) SELECT {sel('year rank', 'score')} FROM ({_RANKED})")(lambda spark, sf: out(analog.analogs_from_field((x := _hist(spark, sf))[1], x[0].df, 3), "year rank", "score"))  # 12.7
put("analog_weights", f"{_IDX}, s2 AS (SELECT year, abs(value - 0.5) AS score FROM idx), k AS (SELECT * FROM ({_RANKED}) WHERE rank IS NOT NULL), c AS (SELECT quantile_cont(CASE WHEN score > 0 THEN score END, 0.5) AS s FROM k), w AS (SELECT year, s / (score + s) AS w FROM k CROSS JOIN c) SELECT {sel('year', 'weight')} FROM (SELECT year, w / sum(w) OVER () AS weight FROM w)")(lambda spark, sf: out(analog.analog_weights(analog.analogs_from_index(_index(spark, sf), 0.5, 3), "inverse"), "year", "weight"))  # 12.8


def _completion(spark, sf) -> DataFrame:
    s = _seasons(spark, sf)
    chosen = spark.createDataFrame([(1996, 0.0, 1), (1998, 0.0, 2)], "year int, score double, rank int")
    seen = s.df.where("year = 2000 AND step < 40").select("nation", "step", "value")
    return analog.complete(s, chosen, seen)


_DONE = SEASONS.format(tail=0).replace("stack AS (", "stack AS MATERIALIZED (") + ", done AS (SELECT a.year AS scenario, a.nation, a.step, CASE WHEN o.value IS NULL THEN 'analog' ELSE 'observed' END AS segment, coalesce(o.value, a.value) AS value FROM stack a LEFT JOIN (SELECT * FROM stack WHERE year = 2000 AND step < 40) o USING (nation, step) WHERE a.year IN (1996, 1998))"
put("complete", f"{_DONE} SELECT segment, {sel('scenario nation step', 'value')} FROM done")(lambda spark, sf: _completion(spark, sf).select("segment", *(F.col(c).cast("long").alias(c) for c in ("scenario", "nation", "step")), F.round("value", 6).alias("value")))  # 12.9
put("scenario_totals", f"{_DONE} SELECT {sel('scenario nation', 'total')} FROM (SELECT scenario, nation, sum(value) AS total FROM done GROUP BY ALL)")(lambda spark, sf: out(analog.scenario_totals(_completion(spark, sf), "nation"), "scenario nation", "total"))  # 12.9
put("issuance_dates", "SELECT CAST(d AS VARCHAR) AS issuance FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events)) WHERE dayofweek(d) IN (1, 4)")(lambda spark, sf: store.issuance_dates(spark, *(str(d) for d in spark.read.parquet(f"{sf}/events.parquet").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first())).select(F.col("issuance").cast("string").alias("issuance")))  # 1.13
put("dekad_totals", "SELECT CAST(dekad AS VARCHAR) AS dekad, event_type, CAST(n AS BIGINT) AS n, round(total, 4) AS total FROM (SELECT CAST(date_trunc('month', ts) AS DATE) + CAST(least((day(ts) - 1) // 10, 2) AS INTEGER) * 10 AS dekad, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)")(lambda spark, sf: scoring.dekad_totals(spark.read.parquet(f"{sf}/events.parquet"), "ts", "value", "10 days", "event_type").select(F.to_date("dekad").cast("string").alias("dekad"), "event_type", "n", F.round("total", 4).alias("total")))  # 2.13


def _seasonal(spark, sf) -> tuple[Cube, Cube]:
    """Cubes with a cyclic season axis: the ship month, by year and cell."""
    line, supplier = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "supplier"))
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select(
        F.year("l_shipdate").alias("year"), (F.month("l_shipdate") - 1).alias("season"), (F.col("l_linenumber") % 2).alias("member"), F.col("s_nationkey").cast("int").alias("cell"), "l_quantity", "l_extendedprice"
    ).where("year BETWEEN 1996 AND 2000")
    h = rows.groupBy("year", "season", "member", "cell").agg(F.avg("l_quantity").alias("value"))
    o = rows.groupBy("year", "season", "cell").agg(F.avg("l_extendedprice").alias("value"))
    return Cube(h, ("year", "season", "member", "cell")), Cube(o, ("year", "season", "cell"))


_SEASONAL = """WITH rows_ AS (SELECT year(l_shipdate) AS year, month(l_shipdate) - 1 AS season, l_linenumber % 2 AS member, s_nationkey AS cell, l_quantity, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) BETWEEN 1996 AND 2000),
sh AS (SELECT year, season, member, cell, avg(l_quantity) AS value FROM rows_ GROUP BY ALL), so AS (SELECT year, season, cell, avg(l_extendedprice) AS value FROM rows_ GROUP BY ALL),
sx AS (SELECT year, season, cell, avg(value) AS x, var_pop(value) AS s2 FROM sh GROUP BY ALL), sp AS (SELECT sx.*, so.value AS y FROM sx JOIN so USING (year, season, cell))"""
_RING = ", ".join(f"({s}, {(s + d) % 12}, {w!r})" for s in range(12) for d, w in linear.cyclic_weights(12, 1.0))
put("smoothed_coefficients", f"{_SEASONAL}, a AS (SELECT season, cell, covar_pop(x, y) / var_pop(x) AS a FROM sp GROUP BY ALL), w(t, f, w) AS (VALUES {_RING}) SELECT {sel('season cell', 'a')} FROM (SELECT w.t AS season, cell, sum(a * w) AS a FROM a JOIN w ON a.season = w.f GROUP BY ALL)")(lambda spark, sf: out(linear.smoothed_coefficients(*_seasonal(spark, sf)), "season cell", "a"))  # 11.18, 7.16
put(
    "smoothed_tercile",
    f"""{_SEASONAL}, fit AS (SELECT season, cell, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) / var_pop(x) AS a, avg(s2) AS ms2, quantile_cont(y, 1.0/3) AS t33, quantile_cont(y, 2.0/3) AS t67 FROM sp GROUP BY ALL),
now_ AS (SELECT season, cell, avg(value) AS f, var_pop(value) AS fs2 FROM sh WHERE year = 2000 GROUP BY ALL), m AS (SELECT season, cell, my + a * (f - mx) AS mu, greatest(sqrt(greatest(vy - a * a * vx, 0.0) / ms2 * fs2), 1e-12) AS sd, t33, t67 FROM now_ JOIN fit USING (season, cell)),
z AS (SELECT season, cell, (t33 - mu) / sd AS za, (t67 - mu) / sd AS zb FROM m) SELECT {sel('season cell', 'p_bn p_nn p_an')} FROM (SELECT season, cell, {phi_sql('za')} AS p_bn, greatest(least({phi_sql('zb')} - {phi_sql('za')}, 1.0), 0.0) AS p_nn, 1 - {phi_sql('zb')} AS p_an FROM z)""",
)(lambda spark, sf: out(linear.smoothed_tercile((x := _seasonal(spark, sf))[0], x[1], x[0].over(x[0].df.where("year = 2000").drop("year"), ["season", "member", "cell"])), "season cell", "p_bn p_nn p_an"))  # 11.16
put("cca_cv")(lambda spark, sf: out(linear.cca_cv(cube.hindcast(spark, sf).mean("member").df.withColumn("model", F.lit("m")), cube.observed(spark, sf)), "year lat lon", "value leverage"))  # 11.6, 11.7
put("logit_tercile")(lambda spark, sf: out(linear.logit(_index(spark, sf), cube.observed(spark, sf), 0.5, least_years=5), "lat lon", "p_bn p_nn p_an p_value"))  # 11.14


# The same operators over all members and all years; the queries above read three members and five seasons.
_ALL_YEARS = range(1995, 2002)
_ALL_SKILL = _SKILL | {"m4": 0.3, "m5": 0.2, "m6": 0.0, "m7": -0.1}


def _all_models(spark, sf) -> DataFrame:
    return cube.hindcast(spark, sf).df.select(F.concat(F.lit("m"), F.col("member")).alias("model"), "year", "lat", "lon", "value")


def _all_skill(spark) -> DataFrame:
    return spark.createDataFrame(list(_ALL_SKILL.items()), "model string, skill double")


put("ensemble_uniform_all", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, CASE WHEN count(*) = 7 THEN avg(value) END AS value FROM hind GROUP BY ALL)")(lambda spark, sf: out(ensemble.uniform(_all_models(spark, sf), _K), "year lat lon", "value"))
put("ensemble_skill_weighted_all", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, sum(value * CASE member WHEN 1 THEN 0.4 WHEN 2 THEN 0.1 WHEN 4 THEN 0.3 WHEN 5 THEN 0.2 ELSE 0.0 END) AS value FROM hind GROUP BY ALL)")(lambda spark, sf: out(ensemble.skill_weighted(_all_models(spark, sf), _K, _all_skill(spark)), "year lat lon", "value"))
put("ensemble_drop_worst_all", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, CASE WHEN count(*) = 6 THEN avg(value) END AS value FROM hind WHERE member <> 3 GROUP BY ALL)")(lambda spark, sf: out(ensemble.drop_worst(_all_models(spark, sf), _K, _all_skill(spark)), "year lat lon", "value"))
put("ensemble_bma_all")(lambda spark, sf: out(ensemble.bma(_all_models(spark, sf), _K, cube.observed(spark, sf).df.withColumn("value", F.col("value") / 1500.0))[0], "year lat lon", "value"))
put("pool_ensembles_all", f"{BASE} SELECT {sel('year lat lon member', 'value')} FROM (SELECT year, lat, lon, member - 1 AS member, value FROM hind)")(lambda spark, sf: out(ensemble.pool(_all_models(spark, sf).withColumn("member", F.lit(0)), _K), "year lat lon member", "value"))


def _all_seasons(spark, sf, tail: int = 0) -> Cube:
    return climate.seasonal_stack(cube.daily(spark, sf), "date", (3, 5), list(_ALL_YEARS), tail_days=tail)


def _all_timed(spark, sf):
    s = _all_seasons(spark, sf, 12)
    first = timing.onset(s, **_ON)
    return first, timing.cessation(s, first, 5.0, 4, 92)


for _m, _f in {
    "seasonal_stack": lambda spark, sf: out(_all_seasons(spark, sf).df, "nation year step", "value"),
    "dry_runs": lambda spark, sf: out(timing.dry_runs(_all_seasons(spark, sf), "step", 5.0), "nation year step run"),
    "rolling_total": lambda spark, sf: out(timing.rolling_total(_all_seasons(spark, sf), "step", 3), "nation year step", "total"),
    "dry_spell": lambda spark, sf: out(timing.dry_spell(_all_seasons(spark, sf), 5.0, 4), "nation year", "longest count"),
    "onset": lambda spark, sf: out(_all_timed(spark, sf)[0], "nation year", "step occurred"),
    "cessation": lambda spark, sf: out(_all_timed(spark, sf)[1], "nation year", "step occurred"),
    "season_length": lambda spark, sf: out(timing.season_length(*_all_timed(spark, sf), "nation", "year"), "nation year", "length"),
}.items():
    put(f"{_m}_all", ORACLES[_m].replace("range(1996, 2001)", "range(1995, 2002)"))(_f)


# Downscaling methods on a common grid, and the front door to the metrics.
_SORTED = ", s AS (SELECT lat, lon, list(value ORDER BY value) AS xs FROM past GROUP BY ALL), t AS (SELECT lat, lon, list(value ORDER BY value) AS ys FROM obs GROUP BY ALL)"
_BCSD = f"{BASE}{_SORTED}, q AS (SELECT member, lat, lon, xs, ys, least(greatest(len([x for x in xs if x < value]) / len(xs), 0.01), 0.99) * (len(xs) - 1) AS spot FROM hind JOIN s USING (lat, lon) JOIN t USING (lat, lon) WHERE year = 2001)"
put("bcsd", f"{_BCSD} SELECT {sel('member lat lon', 'value')} FROM (SELECT member, lat, lon, ys[CAST(floor(spot) AS INT) + 1] * (1 - (spot - floor(spot))) + ys[CAST(least(floor(spot) + 1, len(xs) - 1) AS INT) + 1] * (spot - floor(spot)) AS value FROM q)")(lambda spark, sf: out(calibrate.downscale(*_split(spark, sf), "bcsd").df, "member lat lon", "value"))  # 11.3, 10.10
_DQM = f"""{BASE}, mid AS (SELECT avg(year) AS mid, max(year) AS last FROM (SELECT DISTINCT year FROM past)),
hb AS (SELECT lat, lon, sum((year - mid) * value) / sum((year - mid) * (year - mid)) AS b FROM past CROSS JOIN mid GROUP BY ALL), ob AS (SELECT lat, lon, sum((year - mid) * value) / sum((year - mid) * (year - mid)) AS b FROM obs CROSS JOIN mid WHERE year < 2001 GROUP BY ALL),
hs AS (SELECT lat, lon, avg(value - b * (year - mid)) AS m, stddev_samp(value - b * (year - mid)) AS d FROM past JOIN hb USING (lat, lon) CROSS JOIN mid GROUP BY ALL), os AS (SELECT lat, lon, avg(value - b * (year - mid)) AS m, stddev_samp(value - b * (year - mid)) AS d FROM obs JOIN ob USING (lat, lon) CROSS JOIN mid WHERE year < 2001 GROUP BY ALL)"""
put("dqm_parametric", f"{_DQM} SELECT {sel('member lat lon', 'value')} FROM (SELECT h.member, h.lat, h.lon, os.m + (h.value - hb.b * (last - mid) - hs.m) / hs.d * os.d + hb.b * (last - mid) AS value FROM hind h JOIN hb USING (lat, lon) JOIN hs USING (lat, lon) JOIN os USING (lat, lon) CROSS JOIN mid WHERE h.year = 2001)")(lambda spark, sf: out(calibrate.downscale(*_split(spark, sf), "dqm", variant="parametric").df, "member lat lon", "value"))  # 11.5
_TABLE = " UNION ALL ".join(f"SELECT '{n}' AS metric, value FROM ({ORACLES[q]})" for n, q in (("pearson_r", "pearson_r_pooled"), ("spearman", "spearman_pooled"), ("2afc", "two_afc_pooled"), ("rmse", "rmse_pooled"), ("msss", "msss_pooled")))
put("skill", _TABLE)(lambda spark, sf: metrics.skill(*_predicted(spark, sf), "deterministic").select("metric", (F.round("value", 6) + 0.0).alias("value")))  # 9.19


# Masks, gamma fits, years, analogs by hand, contributions, and the sub-seasonal chain.
_CLIMATE = "SELECT lat, lon, avg(value) AS value FROM obs GROUP BY ALL"
put("dry_mask", f"{BASE} SELECT {sel('lat lon dry')} FROM (SELECT lat, lon, CAST(coalesce(value < 38000.0, FALSE) AS INT) AS dry FROM ({_CLIMATE}))")(lambda spark, sf: out(climate.dry_mask(cube.observed(spark, sf).mean("year"), 38000.0), "lat lon dry"))  # 2.9
put("fit_gamma", f"{BASE} SELECT {sel('lat lon', 'shape scale')} FROM (SELECT lat, lon, CASE WHEN count(*) >= 3 THEN avg(value) * avg(value) / var_pop(value) END AS shape, CASE WHEN count(*) >= 3 THEN var_pop(value) / avg(value) END AS scale FROM obs WHERE value > 0 GROUP BY ALL)")(lambda spark, sf: out(climate.fit_gamma(cube.observed(spark, sf), "year"), "lat lon", "shape scale"))  # 4.12


@put("gamma_round_trip", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM (SELECT year, lat, lon, round(value, 2) AS value FROM obs)")  # 11.19
def gamma_round_trip(spark, sf):
    o = cube.observed(spark, sf)
    law = [F.col("shape"), F.col("scale")]
    scored = o.df.join(climate.fit_gamma(o, "year"), ["lat", "lon"]).withColumn("normal", special.gamma_to_normal(F.col("value"), *law))
    return out(scored.withColumn("value", F.round(special.normal_to_gamma(F.col("normal"), *law), 2)), "year lat lon", "value")


put("parent_cells", f"{BASE} SELECT {sel('year lat lon', 'parent_mean parent_max')} FROM (SELECT year, lat, lon, avg(value) OVER w AS parent_mean, max(value) OVER w AS parent_max FROM obs WINDOW w AS (PARTITION BY year, lat // 2, lon // 2))")(lambda spark, sf: out(regrid.with_parent(cube.observed(spark, sf), 2), "year lat lon", "parent_mean parent_max"))  # 4.16
put("native_years", f"{BASE} SELECT model, {sel('year')} FROM (SELECT DISTINCT concat('m', member) AS model, year FROM hind WHERE year IN (SELECT year FROM obs))")(lambda spark, sf: climate.native_years(_all_models(spark, sf), cube.observed(spark, sf).df).select("model", F.col("year").cast("long").alias("year")))  # 8.9, 2.12
put("shared_years", f"{BASE} SELECT {sel('year')} FROM (SELECT year FROM hind INTERSECT SELECT year FROM obs)")(lambda spark, sf: out(climate.shared_years([cube.hindcast(spark, sf).df, cube.observed(spark, sf).df]), "year"))  # 8.8
put("tercile_mae", f"{BASE}{PROBS} SELECT {sel('', 'value')} FROM (SELECT avg((abs(a.p_bn - b.p_bn) + abs(a.p_nn - b.p_nn) + abs(a.p_an - b.p_an)) * 100 / 3) AS value FROM probs a JOIN probs b ON b.year = a.year - 1 AND a.lat = b.lat AND a.lon = b.lon)")(lambda spark, sf: out(tercile.tercile_mae(p := _probs(spark, sf)[0], p.select((F.col("year") + 1).alias("year"), "lat", "lon", *(F.col(c).__mul__(100).alias(c) for c in tercile.P)), _K), "", "value"))  # 4.14
put("season_times", "SELECT CAST(year AS BIGINT) AS year, CAST(row_number() OVER (PARTITION BY year ORDER BY t) - 1 AS BIGINT) AS step, CAST(t AS VARCHAR) AS time FROM (SELECT DISTINCT year, CAST(date_trunc('month', d) AS DATE) + CAST(10 * least((day(d) - 1) // 10, 2) AS INTEGER) AS t FROM (SELECT y AS year, CAST(unnest(generate_series(make_date(y, 11, 1), make_date(y + 1, 1, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)))")(lambda spark, sf: calendar.season_times(spark, "NDJ", _years_of(spark, sf), "dekad").select(F.col("year").cast("long").alias("year"), F.col("step").cast("long").alias("step"), F.col("time").cast("string").alias("time")))  # 5.8
put("analogs_where", f"{_IDX} SELECT {sel('year rank', 'score')} FROM (SELECT year, CASE WHEN value >= 0 THEN 0.0 END AS score, CASE WHEN value >= 0 THEN sum(CASE WHEN value >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY year) END AS rank FROM idx)")(lambda spark, sf: out(analog.analogs_where(_index(spark, sf).select("year", (F.col("value") >= 0).alias("condition"))), "year rank", "score"))  # 12.5
put("analogs_from_years", f"{BASE} SELECT {sel('year rank', 'score')} FROM (SELECT DISTINCT year, CASE year WHEN 1999 THEN 1 WHEN 1996 THEN 2 END AS rank, CASE WHEN year IN (1999, 1996) THEN 0.0 END AS score FROM obs)")(lambda spark, sf: out(analog.top(analog.analogs_from_years([1999, 1996, 2001], cube.observed(spark, sf).df.select("year")), 2).withColumn("score", F.when(F.col("rank").isNotNull(), F.col("score"))), "year rank", "score"))  # 12.5, 8.3
put("analogs_filtered", f"{_IDX}, s2 AS (SELECT year, abs(value - 0.5) AS score, value FROM idx), r AS ({_RANKED.replace('SELECT year,', 'SELECT year, value,', 1)}) SELECT {sel('year rank', 'score')} FROM (SELECT year, score, CASE WHEN rank IS NOT NULL AND value > 0 THEN row_number() OVER (PARTITION BY rank IS NOT NULL AND value > 0 ORDER BY rank) END AS rank FROM r)")(lambda spark, sf: out(analog.keep_years(analog.analogs_from_index(i := _index(spark, sf), 0.5, 3), i.select("year", (F.col("value") > 0).alias("keep"))), "year rank", "score"))  # 2.15
put("accumulation", f"{SEASONS.format(tail=0).replace('range(1996, 2001)', 'range(1995, 2002)')} SELECT {sel('nation scenario step', 'accumulation')} FROM (SELECT nation, year AS scenario, step, sum(value) OVER (PARTITION BY nation, year ORDER BY step) AS accumulation FROM stack)")(lambda spark, sf: out(analog.accumulation(_all_seasons(spark, sf).df.withColumnRenamed("year", "scenario"), "nation"), "nation scenario step", "accumulation"))  # 7.10
_COMBINED = f"{BASE}, comb AS (SELECT year, lat, lon, CASE WHEN count(*) = 7 THEN avg(value) END AS value FROM hind GROUP BY ALL)"


def _corr_sql(table: str, key: str) -> str:
    """Correlation of f and o by key; each mean over all its values that are there."""
    keys = key.split(", ")
    return f"(SELECT {key}, sum((f - mf) * (o - mo)) / sqrt(sum((f - mf) * (f - mf)) * sum((o - mo) * (o - mo))) AS value FROM (SELECT *, avg(f) OVER (PARTITION BY {key}) AS mf, avg(o) OVER (PARTITION BY {key}) AS mo FROM {table}) GROUP BY {', '.join(keys)})"


def _combined(spark, sf) -> tuple[DataFrame, Cube]:
    models = _all_models(spark, sf)
    return models, Cube(ensemble.uniform(models, _K), ("year", "lat", "lon"))


put("member_correlations", f"{_COMBINED}, t AS (SELECT model, year, f, o FROM (SELECT concat('m', member) AS model, year, avg(value) AS f FROM hind GROUP BY ALL) JOIN (SELECT year, avg(value) AS o FROM comb GROUP BY ALL) USING (year)) SELECT model, {sel('', 'value')} FROM {_corr_sql('t', 'model')}")(lambda spark, sf: ensemble.member_correlations((x := _combined(spark, sf))[0], x[1].df).select("model", (F.round("value", 6) + 0.0).alias("value")))  # 10.7
put("skill_deltas", f"{_COMBINED}, t AS (SELECT concat('m', member) AS model, h.lat, h.lon, h.value AS f, o.value AS o FROM hind h JOIN obs o USING (year, lat, lon)), c AS (SELECT c.lat, c.lon, c.value AS f, o.value AS o FROM comb c JOIN obs o USING (year, lat, lon)) SELECT model, {sel('lat lon', 'value')} FROM (SELECT model, a.lat, a.lon, CASE WHEN isfinite(b.value - a.value) THEN b.value - a.value END AS value FROM {_corr_sql('t', 'model, lat, lon')} a JOIN {_corr_sql('c', 'lat, lon')} b USING (lat, lon))")(lambda spark, sf: ensemble.skill_deltas((x := _combined(spark, sf))[0], x[1], cube.observed(spark, sf)).select("model", *(F.col(c).cast("long").alias(c) for c in ("lat", "lon")), (F.round("value", 6) + 0.0).alias("value")))  # 10.7
put("spread_error_diagnostics", f"{BASE}, m AS (SELECT year, lat, lon, stddev_pop(h.value) AS spread, abs(avg(h.value) - max(o.value) / 1500) AS error FROM hind h JOIN obs o USING (year, lat, lon) GROUP BY ALL) SELECT {sel('year', 'spread error')} FROM (SELECT year, avg(spread) AS spread, avg(error) AS error FROM m GROUP BY ALL)")(lambda spark, sf: out(metrics.spread_error_diagnostics(cube.hindcast(spark, sf), (o := cube.observed(spark, sf)).over(o.df.withColumn("value", F.col("value") / 1500.0))), "year", "spread error"))  # 9.15
put("require_years", f"{BASE} SELECT {sel('year lat lon', 'value')} FROM obs WHERE year IN (1996, 1998)")(lambda spark, sf: out(climate.require_years(cube.observed(spark, sf).df, [1996, 1998]), "year lat lon", "value"))  # 2.12, 8.10
put("new_since", "SELECT CAST(d AS VARCHAR) AS issuance FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) IN (1, 4) AND d NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49)")(lambda spark, sf: store.new_since(spark, "1996-01-01", "1996-12-31", spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("issuance"))).select(F.col("issuance").cast("string").alias("issuance")))  # 1.13


@put("select_targets", "SELECT country, season, CAST(i // 100 AS BIGINT) AS init_year, CAST(i % 100 AS BIGINT) AS init_month FROM (SELECT country, season, max(iy * 100 + m) AS i FROM (SELECT *, ty - CASE WHEN m < sm THEN 0 ELSE 1 END AS iy FROM (SELECT n_name AS country, 's' || sm AS season, sm, CASE WHEN sm > 5 THEN 2024 ELSE 2025 END AS ty, unnest([(sm + 8) % 12 + 1, (sm + 10) % 12 + 1]) AS m FROM (SELECT n_name, n_nationkey % 12 + 1 AS sm FROM nation))) WHERE make_date(iy, m, 1) <= DATE '2024-05-01' GROUP BY ALL)")  # 5.20
def select_targets(spark, sf):
    start = (F.col("n_nationkey") % 12 + 1).cast("int")
    seasons = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("country"), start.alias("start_month")).withColumn("season", F.concat(F.lit("s"), F.col("start_month")))
    months = F.array(*((F.col("start_month") + k) % 12 + 1 for k in (8, 10)))
    got = store.select_targets(seasons.withColumn("init_months", months), F.lit("2024-05-20").cast("date"))
    return got.select("country", "season", *(F.col(c).cast("long").alias(c) for c in ("init_year", "init_month")))


def _leads(spark, sf) -> Cube:
    """Quantity shipped by priority, order date and hours from order to shipping."""
    order, line = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = line.join(order, line["l_orderkey"] == order["o_orderkey"]).select(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("issued"), (F.datediff("l_shipdate", "o_orderdate") * 24).alias("lead"), "l_quantity")
    return Cube(rows.groupBy("priority", "issued", "lead").agg(F.avg("l_quantity").alias("value")), ("priority", "issued", "lead"))


_DEKAD = "CAST(date_trunc('month', {d}) AS DATE) + CAST(10 * least((day({d}) - 1) // 10, 2) AS INTEGER)"
put("dekads_from_leads", f"WITH c AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS issued, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT priority, CAST(issued AS VARCHAR) AS issued, CAST(dekad AS VARCHAR) AS dekad, {sel('', 'value')} FROM (SELECT priority, issued, {_DEKAD.format(d='day')} AS dekad, avg(value) AS value FROM c GROUP BY ALL)")(lambda spark, sf: subseasonal.dekads_from_leads(_leads(spark, sf), "issued", "lead").df.select("priority", F.col("issued").cast("string").alias("issued"), F.col("dekad").cast("string").alias("dekad"), (F.round("value", 6) + 0.0).alias("value")))  # 2.5
put("same_day_of_year", f"{DAILY} SELECT {sel('nation year', 'value')} FROM (SELECT nation, year(date) AS year, value FROM daily WHERE dayofyear(date) = dayofyear(DATE '2001-04-11') AND year(date) BETWEEN 1995 AND 2001)")(lambda spark, sf: out(subseasonal.same_day_of_year(cube.daily(spark, sf), "date", dt.date(2001, 4, 11), 1995, 2001).df, "nation year", "value"))  # 2.4


def _shipped(spark, sf) -> Cube:
    return Cube(spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value")), ("date",))


put("dekads_from_days", f"WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY ALL) SELECT CAST(dekad AS VARCHAR) AS dekad, {sel('', 'value')} FROM (SELECT {_DEKAD.format(d='date')} AS dekad, avg(value) AS value FROM d WHERE day(date) <= 30 GROUP BY ALL HAVING count(*) = 10)")(lambda spark, sf: subseasonal.dekads_from_days(_shipped(spark, sf), "date").df.select(F.col("dekad").cast("string").alias("dekad"), (F.round("value", 6) + 0.0).alias("value")))  # 2.6
put("tercile_probabilities", f"{BASE}, t AS (SELECT lat, lon, quantile_cont(value, 1.0/3) AS t33, quantile_cont(value, 2.0/3) AS t67 FROM hmean GROUP BY ALL), p AS (SELECT year, lat, lon, count(*) FILTER (value < t33) / CAST(count(*) AS DOUBLE) AS below, count(*) FILTER (value > t67) / CAST(count(*) AS DOUBLE) AS above FROM hind JOIN t USING (lat, lon) GROUP BY ALL) SELECT category, {sel('year lat lon')}, round(CAST(CAST(p AS FLOAT) AS DOUBLE), 5) + 0.0 AS p FROM (SELECT year, lat, lon, unnest(['below', 'normal', 'above']) AS category, unnest([below, 1 - below - above, above]) AS p FROM p)")(lambda spark, sf: subseasonal.tercile_probabilities(h := cube.hindcast(spark, sf), h.mean("member")).select("category", *(F.col(c).cast("long").alias(c) for c in _K), (F.round(F.col("p").cast("double"), 5) + 0.0).alias("p")))  # 6.10
put(
    "score_pairs",
    f"""{BASE}{PRED}{PROBS}, clim AS (SELECT lat, lon, avg(value) AS m, quantile_cont(value, 1.0/3) AS a, quantile_cont(value, 2.0/3) AS b FROM obs GROUP BY ALL),
c AS (SELECT year, f, o, f - m AS fa, o - m AS oa, p_bn, p_bn + p_nn AS p2, p_bn + p_nn + p_an AS p3, CASE WHEN o < a THEN 1.0 ELSE 0.0 END AS c1, CASE WHEN o > b THEN 0.0 ELSE 1.0 END AS c2 FROM pair JOIN clim USING (lat, lon) JOIN probs USING (year, lat, lon))
SELECT {sel('year', 'acc rmse bias rpss')} FROM (SELECT year, corr(fa, oa) AS acc, sqrt(avg((f - o) * (f - o))) AS rmse, avg(f - o) AS bias,
1 - avg(power(p_bn - c1, 2) + power(p2 - c2, 2) + power(p3 - 1, 2)) / avg(power(1.0 / 3 - c1, 2) + power(2.0 / 3 - c2, 2)) AS rpss FROM c GROUP BY year)""",
)(lambda spark, sf: out(subseasonal.score_pairs(*_predicted(spark, sf), cube.observed(spark, sf), ["year"], _probs(spark, sf)[0]), "year", "acc rmse bias rpss"))  # 9.18


@put("modes_north")  # 11.9
def modes_north(spark, sf):
    x, y, k = linear.modes_north(cube.hindcast(spark, sf), cube.observed(spark, sf))
    return spark.createDataFrame([(x, y, k)], "x_modes long, y_modes long, modes long")


@put("cca_modes_kendall")  # 11.8
def cca_modes_kendall(spark, sf):
    found = linear.search_modes(_all_models(spark, sf), cube.observed(spark, sf), 1, (1, 3), (1, 3), (1, 3))
    return found.select("model", *(F.col(c).cast("long").alias(c) for c in ("x_modes", "y_modes", "modes", "cells")), (F.round("tau", 6) + 0.0).alias("tau"), "best")


def _dealt(spark, sf) -> Cube:
    """Mean price by year and one of 20 x 20 cells that parts are dealt to."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    cell = F.pmod("l_partkey", F.lit(400))
    df = line.groupBy(F.year("l_shipdate").alias("year"), (F.floor(cell / 20) * 0.25).alias("lat"), (cell % 20 * 0.25).alias("lon")).agg(F.avg("l_extendedprice").alias("value"))
    return Cube(df, ("year", "lat", "lon"))


def _land(spark, sf) -> DataFrame:
    """Parts on a grid 50 cells wide: price as height, size as wind."""
    at = F.col("p_partkey") - 1
    return spark.read.parquet(f"{sf}/part.parquet").select((F.floor(at / 50) * 0.001).alias("lat"), (at % 50 * 0.001).alias("lon"), F.col("p_retailprice").alias("z"), (F.col("p_size") / 50 + 0.5).alias("u"), (F.col("p_size") % 7 - 3).cast("double").alias("v"))


@put("rank_analog")  # 11.10
def rank_analog(spark, sf):
    h = cube.hindcast(spark, sf)
    now = h.over(h.df.where("year = 2001").drop("year"), ["member", "lat", "lon"])
    df = terrain.rank_analog(now, h.over(h.df.where("year < 2001")), _dealt(spark, sf), closing=5, sigma=1.0, size=8).df
    return df.select(F.col("member").cast("long").alias("member"), "lat", "lon", (F.round("value", 6) + 0.0).alias("value"))


@put("wind_effect")  # 11.11
def wind_effect(spark, sf):
    return terrain.wind_effect(_land(spark, sf), reach_km=1.5, size=64).select(*(F.round(c, 6).alias(c) for c in ("lat", "lon", "effect")))


@put("orographic")  # 11.11, 4.16
def orographic(spark, sf):
    land = _land(spark, sf)
    blocks = land.groupBy(*((F.floor(F.round(F.col(c) / 0.001) / 10) * 0.01 + 0.0045).alias(c) for c in ("lat", "lon"))).agg(F.avg("u").alias("value"))
    return terrain.orographic(Cube(blocks, ("lat", "lon")), land, reach_km=1.5, size=64).df.select(*(F.round(c, 6).alias(c) for c in ("lat", "lon", "value")))


@put("dry_runs_stream", f"{DAILY}, r AS (SELECT nation, date, value, row_number() OVER (PARTITION BY nation ORDER BY date) AS i FROM daily), w AS (SELECT *, max(CASE WHEN value > 1 THEN i END) OVER (PARTITION BY nation ORDER BY date) AS wet FROM r) SELECT {sel('nation')}, CAST(date AS VARCHAR) AS date, {sel('run')} FROM (SELECT nation, date, i - coalesce(wet, 0) AS run FROM w)")  # S.5
def dry_runs_stream(spark, sf):
    """Two years a batch, and a row that makes all days final."""
    folder = shared_folder(spark, "dry-runs")
    days = cube.daily(spark, sf).df
    for first in range(1995, 2002, 2):
        days.where(F.year("date").between(first, first + 1)).coalesce(1).write.parquet(f"{folder}/in/{first}")
    days.limit(1).select(F.lit(-1).alias("nation"), F.lit("2003-01-01").cast("date").alias("date"), F.lit(0.0).alias("value")).coalesce(1).write.parquet(f"{folder}/in/end")
    spells.use_state(spark)
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    runs = spells.dry_runs_of(stream, ["nation"], 1.0)
    runs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(runs.schema).parquet(f"{folder}/out").where("nation >= 0").select(F.col("nation").cast("long").alias("nation"), F.col("date").cast("string").alias("date"), F.col("run").cast("long").alias("run"))


@put("pending_scores", f"{BASE}{PRED} SELECT {sel('year n', 'bias rmse')}, CASE WHEN year < 2001 THEN 'final' ELSE 'live' END AS source FROM (SELECT year, count(*) AS n, avg(f - o) AS bias, sqrt(avg((f - o) * (f - o))) AS rmse FROM pair GROUP BY year)")  # S.1, 10.16
def pending_scores(spark, sf):
    """Forecasts of each year are issued in a file of its own; the last year's observations are live."""
    folder, (told, seen) = shared_folder(spark, "pending"), _predicted(spark, sf)
    issued = told.df.select("year", "lat", "lon", F.col("value").alias("forecast"))
    issued.repartition(4, "year").write.parquet(f"{folder}/in")
    observed = lambda s: seen.df.select(*_K, "value").withColumn("source", F.when(F.col("year") < 2001, "final").otherwise("live"))
    error = F.col("forecast") - F.col("value")
    score = lambda rows: rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"))
    sink = scoring.PendingScores(f"{folder}/store", f"{folder}/log", ("year",), ("lat", "lon"), observed, score)
    stream = spark.readStream.schema(issued.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    scoring.score_stream(stream, sink, f"{folder}/state").awaitTermination()
    return scoring.current_scores(spark, sink.log, ["year"]).select(*(F.col(c).cast("long").alias(c) for c in ("year", "n")), *((F.round(c, 6) + 0.0).alias(c) for c in ("bias", "rmse")), "source")


@put("spread_factors")  # 11.16
def spread_factors(spark, sf):
    o = cube.observed(spark, sf)
    return out(solvers.spread_factors(cube.hindcast(spark, sf), o.over(o.df.withColumn("value", F.col("value") / 1500.0)), constrained=False), "lat lon", "a b").select("lat", "lon", *(F.round(c, 4).alias(c) for c in "ab"))


@put("logit_multinomial")  # 11.14
def logit_multinomial(spark, sf):
    return out(solvers.logistic(_index(spark, sf), cube.observed(spark, sf), 0.5, "multinomial", least_years=5), "lat lon", "p_bn p_nn p_an p_value")


@put("permutation_test")  # 9.16
def permutation_test(spark, sf):
    return out(solvers.permutation(cube.hindcast(spark, sf), cube.observed(spark, sf), n=1000, seed=1), "lat lon", "statistic p")


_BOX = "SELECT n_nationkey AS cell, n_nationkey * 0.0007 AS south, n_nationkey * 0.0007 + 0.0061 AS north, n_nationkey % 5 * 0.009 AS west, n_nationkey % 5 * 0.009 + 0.0123 AS east FROM nation"
_BOXES = f"WITH points AS (SELECT ((p_partkey - 1) // 50) * CAST(0.001 AS DOUBLE) AS lat, ((p_partkey - 1) % 50) * CAST(0.001 AS DOUBLE) AS lon, p_retailprice AS value FROM part), boxes AS ({_BOX})".replace("0.0007", "CAST(0.0007 AS DOUBLE)").replace("0.0061", "CAST(0.0061 AS DOUBLE)").replace("0.009 ", "CAST(0.009 AS DOUBLE) ").replace("0.0123", "CAST(0.0123 AS DOUBLE)")


@put("range_stats", f"{_BOXES} SELECT {sel('cell', 'elevation roughness')} FROM (SELECT cell, avg(value) AS elevation, stddev_pop(value) AS roughness FROM points JOIN boxes ON lat >= south AND lat < north AND lon >= west AND lon < east GROUP BY cell)")  # 3.9
def range_stats(spark, sf):
    k = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("cell"), (k * 0.0007).alias("south"), (k * 0.0007 + 0.0061).alias("north"), (k % 5 * 0.009).alias("west"), (k % 5 * 0.009 + 0.0123).alias("east"))
    return out(regrid.range_stats(_land(spark, sf).select("lat", "lon", F.col("z").alias("value")), boxes, step=0.006), "cell", "elevation roughness")


_TAIL = "CASE WHEN f < s1 AND s2 > s1 THEN t1 + (t2 - t1) / (s2 - s1) * (f - s1) WHEN f > s7 AND s7 > s6 THEN t7 + (t7 - t6) / (s7 - s6) * (f - s7) END"


@put("quantile_map_tails", f"{BASE}, s AS (SELECT lat, lon, list_sort(list(value)) AS s FROM past GROUP BY ALL), t AS (SELECT lat, lon, list_sort(list(value)) AS t FROM obs GROUP BY ALL), x AS (SELECT lat, lon, member, value * k AS f FROM hind, (SELECT unnest([0.5, 2.0]) AS k) WHERE year = 2001), j AS (SELECT lat, lon, member, f, s[1] AS s1, s[2] AS s2, s[-1] AS s7, s[-2] AS s6, t[1] AS t1, t[2] AS t2, t[-1] AS t7, t[-2] AS t6 FROM x JOIN s USING (lat, lon) JOIN t USING (lat, lon)) SELECT {sel('lat lon member', 'value')} FROM (SELECT lat, lon, member, {_TAIL} AS value FROM j WHERE (f < s1 AND s2 > s1) OR (f > s7 AND s7 > s6))")  # 5.12
def quantile_map_tails(spark, sf):
    """Values of half and twice the latest ones that lie beyond the hindcast's range."""
    (_, past), h, o = _hist(spark, sf), cube.hindcast(spark, sf), cube.observed(spark, sf)
    now = h.df.where("year = 2001").select("lat", "lon", "member", F.explode(F.array(F.lit(0.5), F.lit(2.0))).alias("k"), "value").withColumn("value", F.col("value") * F.col("k"))
    ends = past.df.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("value")).alias("_s")).select("lat", "lon", F.element_at("_s", 1).alias("_lo"), F.element_at("_s", -1).alias("_hi"), F.element_at("_s", 2).alias("_lo2"), F.element_at("_s", -2).alias("_hi2"))
    far = now.join(ends, ["lat", "lon"]).where("(value < _lo AND _lo2 > _lo) OR (value > _hi AND _hi > _hi2)").select("lat", "lon", "member", "k", "value")
    return out(calibrate.quantile_map(Cube(far, ("lat", "lon", "member", "k")), past, o, extrapolate="linear").df, "lat lon member", "value")


_SVSLRF = f"SELECT 'rpss' AS metric, value FROM ({ORACLES['rpss_pooled']}) UNION ALL SELECT metric, value FROM ({ORACLES['roc_areas']}) UNION ALL SELECT 'reliability' AS metric, value FROM ({ORACLES['reliability']})"


@put("skill_svslrf", _SVSLRF)  # 9.19
def skill_svslrf(spark, sf):
    return metrics.skill(*_probs(spark, sf), "svslrf").select("metric", (F.round("value", 6) + 0.0).alias("value"))


def _tracks(spark, sf) -> DataFrame:
    """Line numbers as seven models of two tracks, one member each."""
    m = F.col("member")
    return cube.hindcast(spark, sf).df.select(F.when(m <= 3, "a").otherwise("b").alias("track"), F.concat(F.lit("m"), m).alias("model"), "year", F.lit(0).alias("member"), "lat", "lon", "value")


@put("seasonal_mme")  # 10.12, 2.13, 6.11, 11.17
def seasonal_mme(spark, sf):
    got = seasonal.seasonal_mme(_tracks(spark, sf), cube.observed(spark, sf), modes=(2, 2, 1), aggregation="per_model", names=["pearson_r"])
    return out(got.terciles.join(got.forecast, ["lat", "lon"]), "lat lon", "value p_bn p_nn p_an")


@put("ensemble_nested")  # 10.5, 10.6
def ensemble_nested(spark, sf):
    o = cube.observed(spark, sf)
    got = nested.ensemble(_all_models(spark, sf), o.over(o.df.withColumn("value", F.col("value") / 1500.0)), "skill_weighted", True, guards={"shrinkage": 0.2})
    return out(got.predictions, "year lat lon", "value")


@put("optimize_methods")  # 10.9
def optimize_methods(spark, sf):
    got = nested.optimize(cube.hindcast(spark, sf), cube.observed(spark, sf), ("delta", "bcsd", "qm"))
    return out(got.forecast.df, "member lat lon", "value").withColumn("method", F.lit(got.method))


@put("downscale_grids")  # 10.10, 11.2, 11.3
def downscale_grids(spark, sf):
    """The last year by the years before it, from 5 x 5 cells to 20 x 20."""
    h, o = cube.hindcast(spark, sf), _dealt(spark, sf)
    wide = o.over(o.df.withColumn("value", F.col("value") / 1500.0))
    parts = [calibrate.downscale(None, h, wide, m, regrid=True).df.withColumn("method", F.lit(m)) for m in ("delta", "bcsd")]
    return parts[0].unionByName(parts[1]).select("method", F.col("member").cast("long").alias("member"), "lat", "lon", (F.round("value", 6) + 0.0).alias("value"))
