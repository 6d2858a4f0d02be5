"""Registered queries of the time-series engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import dates, features, lags, metrics, smoothing
from chronoloom.models import forecast as models
from chronoloom.models.intervals import bootstrap_interval
from chronoloom.operators import clean, demand, hierarchy, outliers, rollup
from chronoloom.series import Panel
from chronoloom.streaming import streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = Panel("k")
HOURS = Panel("k", freq="H")

#: The series: SQL and the same columns in Spark.
SOURCES = {
    "orders": ("o_orderpriority", "o_orderdate", "o_totalprice"),
    "events": ("event_type", "ts", "value"),
    "users": ("user_id", "ts", "value"),
    "parts": ("l_partkey", "l_shipdate", "l_quantity"),
    "flags": ("l_returnflag", "l_shipdate", "l_quantity"),
}
TABLES = {"orders": "orders", "events": "events", "users": "events", "parts": "lineitem", "flags": "lineitem"}


def _rows(spark: SparkSession, sf_dir: str, source: str = "orders", exact: bool = False) -> DataFrame:
    key, time, value = SOURCES[source]
    t = F.col(time).cast("timestamp_ntz") if exact else F.to_date(time)
    return spark.read.parquet(f"{sf_dir}/{TABLES[source]}.parquet").select(F.col(key).cast("string").alias("k"), t.alias("ds"), F.col(value).cast("double").alias("y"))


def _sql(source: str = "orders", exact: bool = False) -> str:
    key, time, value = SOURCES[source]
    kind = "TIMESTAMP" if exact else "DATE"
    return f"s AS (SELECT CAST({key} AS VARCHAR) AS k, CAST({time} AS {kind}) AS ds, CAST({value} AS DOUBLE) AS y FROM {TABLES[source]})"


def _rounded(column: str, digits: int) -> Column:
    """A double rounded as SQL does it: scaled first, so that what prints as a tie (46.56625) goes to the side that its product is on."""
    scaled = F.round(F.col(column) * 10.0**digits, 0) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(F.col(column))


def _out(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms."""
    kinds = dict(df.dtypes)
    return df.select(*[_rounded(f"`{c}`", digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in names or df.columns])


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# Cleansing

MERGED = {
    "sum": "SELECT k, ds, coalesce(sum(y), 0) AS y FROM s GROUP BY k, ds",
    "mean": "SELECT k, ds, avg(y) AS y FROM s GROUP BY k, ds",
    "median": "SELECT k, ds, median(y) AS y FROM s GROUP BY k, ds",
    "mode": "SELECT k, ds, y FROM (SELECT k, ds, y, row_number() OVER (PARTITION BY k, ds ORDER BY count(*) DESC, y) AS r FROM s WHERE y IS NOT NULL GROUP BY k, ds, y) WHERE r = 1",
}
CALENDAR = """c AS (
  SELECT g.k, g.ds, d.y FROM (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM (SELECT k, min(ds) AS lo, max(ds) AS hi FROM d GROUP BY k)) g
  LEFT JOIN d ON d.k = g.k AND d.ds = g.ds)"""
_PAST = "OVER (PARTITION BY k ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "OVER (PARTITION BY k ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _line(limit: int | None = None) -> str:
    inside = f"i - pi <= {limit}" if limit else "true"
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ds) AS i FROM c),
  b AS (SELECT *, last_value(y IGNORE NULLS) {_PAST} AS pv, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) {_PAST} AS pi, first_value(y IGNORE NULLS) {_NEXT} AS nv, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) {_NEXT} AS ni FROM i),
  l AS (SELECT k, ds, coalesce(y, CASE WHEN {inside} THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END) AS y FROM b)"""


def _chain(*parts: str, source: str = "orders", last: str, digits: int = 4, exact: bool = False) -> str:
    return f"WITH {', '.join([_sql(source, exact), *parts])} SELECT k, ds, round(y, {digits}) AS y FROM {last}"


for _how in clean.DUPLICATES:
    query(f"dedupe_{_how}", _chain(f"d AS ({MERGED[_how]})", last="d"))(lambda s, d, how=_how: _out(clean.deduplicated(_rows(s, d), P, how)))
for _fill in clean.FILLS:
    _value = {"zero": "0", "mean": "avg(y) OVER (PARTITION BY k)", "median": "median(y) OVER (PARTITION BY k)"}[_fill]
    query(f"fill_{_fill}", _chain(f"d AS ({MERGED['sum']})", CALENDAR, f"f AS (SELECT k, ds, coalesce(y, {_value}) AS y FROM c)", last="f"))(lambda s, d, how=_fill: _out(clean.filled(clean.completed(clean.deduplicated(_rows(s, d), P, "sum"), P), P, how)))
_PIPE = (f"d AS ({MERGED['sum']})", CALENDAR)


@query("calendar_complete", _chain(*_PIPE, last="c"))
def calendar_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.completed(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P))


@query("calendar_hourly", f"WITH {_sql('events', True)}, d AS (SELECT k, date_trunc('hour', ds) AS ds, sum(y) AS y FROM s GROUP BY ALL), g AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds FROM (SELECT k, min(ds) AS lo, max(ds) AS hi FROM d GROUP BY k)) SELECT g.k, g.ds, round(coalesce(d.y, 0), 4) AS y FROM g LEFT JOIN d ON d.k = g.k AND d.ds = g.ds")
def calendar_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.cleansed(_rows(spark, sf_dir, "events", True), HOURS, "sum", "zero"))


@query("interpolate_linear", _chain(*_PIPE, _line(), last="l"))
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.interpolated(clean.completed(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P), P))


@query("interpolate_limit", _chain(*_PIPE, _line(1), last="l"))
def interpolate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.interpolated(clean.completed(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P), P, limit=1))


#: Where a line may fill, by direction and area, of runs of at most two nulls.
for _name, _inside, _options in (
    ("backward", "ni - i <= 2", {"limit_direction": "backward"}),
    ("both", "(i - pi <= 2 OR ni - i <= 2)", {"limit_direction": "both"}),
    ("inside", "(i - pi <= 2 AND nv IS NOT NULL)", {"limit_area": "inside"}),
):
    query(f"interpolate_{_name}", _chain(f"d AS ({MERGED['mean']})", CALENDAR, _line().replace("WHEN true", f"WHEN {_inside}").replace("WHEN nv IS NULL THEN pv", "WHEN nv IS NULL OR pv IS NULL THEN coalesce(pv, nv)"), source="users", last="l"))(lambda s, d, o=_options: _out(clean.interpolated(clean.completed(clean.deduplicated(_rows(s, d, "users"), P, "mean"), P), P, limit=2, **o)))


@query("interpolate_cubic")
def interpolate_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spline through the days of each user's values."""
    return _out(clean.interpolated(clean.completed(clean.deduplicated(_rows(spark, sf_dir, "users"), P, "mean"), P), P, "cubic"))


_ZERO = "f AS (SELECT k, ds, coalesce(y, 0) AS y FROM c)"


def _pad(column: str, edge: str, low: str, high: str) -> str:
    return _chain(*_PIPE, _ZERO, f"e AS (SELECT k, {edge}(ds) AS e, {'arg_min' if edge == 'min' else 'arg_max'}(y, ds) AS v FROM f GROUP BY k), p AS (SELECT k, CAST(unnest(generate_series({low}, {high}, INTERVAL 1 DAY)) AS DATE) AS ds, {column} AS y FROM e), u AS (SELECT * FROM f UNION ALL SELECT * FROM p)", last="u")


_BACK, _AHEAD = "1994-11-15", "2001-12-24"
for _name, _sql_text, _options in (
    ("pad_zero_back", _pad("0.0", "min", f"DATE '{_BACK}'", "e - INTERVAL 1 DAY"), {"zero_back_to": _BACK}),
    ("pad_repeat_back", _pad("v", "min", f"DATE '{_BACK}'", "e - INTERVAL 1 DAY"), {"repeat_back_to": _BACK}),
    ("pad_repeat_forward", _pad("v", "max", "e + INTERVAL 1 DAY", f"DATE '{_AHEAD}'"), {"repeat_forward_to": _AHEAD}),
):
    query(_name, _sql_text)(lambda s, d, o=_options: _out(clean.cleansed(_rows(s, d), P, "sum", "zero", **o)))

# Outliers

_IQR = "q AS (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY k) AS a, quantile_cont(y, 0.75) OVER (PARTITION BY k) AS b FROM s), o AS (SELECT k, ds, y, CASE WHEN y BETWEEN a - 2.2 * (b - a) AND b + 2.2 * (b - a) THEN 1 ELSE -1 END AS inlier FROM q)"


@query("outlier_iqr", f"WITH {_sql('events', True)}, {_IQR} SELECT k, ds, y, inlier FROM o")
def outlier_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.iqr(_rows(spark, sf_dir, "events", True), P)


@query("outlier_zscore", f"WITH {_sql('events', True)}, m AS (SELECT *, median(y) OVER (PARTITION BY k) AS m, avg(y) OVER (PARTITION BY k) AS a, stddev_pop(y) OVER (PARTITION BY k) AS sd FROM s), z AS (SELECT *, median(abs(y - m)) OVER (PARTITION BY k) AS mad FROM m) SELECT k, ds, y, CASE WHEN CASE WHEN mad <> 0 THEN abs(0.6745 * (y - m) / mad) ELSE coalesce(abs((y - a) / nullif(sd, 0)), 0) END < 5 THEN 1 ELSE -1 END AS inlier FROM z")
def outlier_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.modified_zscore(_rows(spark, sf_dir, "events", True), P)


@query("outlier_rolling", f"""WITH {_sql('orders')}, d AS ({MERGED['sum']}), r AS (SELECT *, row_number() OVER w AS i, sum(y) OVER w AS c, count(*) OVER (PARTITION BY k) // 2 AS w, avg(y) OVER (PARTITION BY k) AS a FROM d WINDOW w AS (PARTITION BY k ORDER BY ds, y ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT r.k, r.ds, r.y, abs(r.y - CASE WHEN r.i < r.w THEN r.a ELSE (r.c - coalesce(p.c, 0)) / r.w END) AS off FROM r LEFT JOIN r p ON p.k = r.k AND p.i = r.i - r.w),
  t AS (SELECT *, quantile_cont(off, 0.9) OVER (PARTITION BY k) AS top FROM v) SELECT k, ds, round(y, 4) AS y, CASE WHEN y <= top THEN 1 ELSE -1 END AS inlier FROM t""")
def outlier_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(outliers.rolling_window(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P))


@query("outlier_cap", f"""WITH {_sql('orders')}, d AS ({MERGED['sum']}), {CALENDAR}, z AS (SELECT k, ds, coalesce(y, 0) AS y FROM c), r AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN abs(y - avg(y) OVER w) END AS off FROM z WINDOW w AS (PARTITION BY k ORDER BY ds ROWS 13 PRECEDING)),
  t AS (SELECT *, quantile_cont(off, 0.95) OVER (PARTITION BY k) AS top FROM r) SELECT k, ds, round(y, 4) AS y, round(greatest(0, least(y, top)), 4) AS capped FROM t""")
def outlier_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(outliers.capped(clean.completed(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P), P))


@query("outlier_dbscan", f"""WITH {_sql('events', True)}, n AS (SELECT *, count(*) OVER (PARTITION BY k ORDER BY y RANGE BETWEEN 2.0 PRECEDING AND 2.0 FOLLOWING) >= 5 AS core FROM s),
  m AS (SELECT *, max(CASE WHEN core THEN y END) OVER (PARTITION BY k ORDER BY y RANGE BETWEEN 2.0 PRECEDING AND CURRENT ROW) AS a, min(CASE WHEN core THEN y END) OVER (PARTITION BY k ORDER BY y RANGE BETWEEN CURRENT ROW AND 2.0 FOLLOWING) AS b FROM n)
  SELECT k, ds, y, CASE WHEN a IS NULL AND b IS NULL THEN -1 ELSE 1 END AS inlier FROM m""")
def outlier_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.dbscan(_rows(spark, sf_dir, "events", True), P).drop("cluster")


@query("outlier_residual", f"""WITH {_sql('orders')}, d AS ({MERGED['sum']}), p AS (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY ds) AS x FROM d), f AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p GROUP BY k),
  e AS (SELECT p.k, p.ds, p.y, pow(p.y - f.a - f.b * p.x, 2) AS e FROM p JOIN f ON f.k = p.k), t AS (SELECT *, avg(e) OVER (PARTITION BY k) + stddev_samp(e) OVER (PARTITION BY k) AS top FROM e)
  SELECT k, ds, round(y, 4) AS y, CASE WHEN e IS NULL OR e < top THEN 1 ELSE -1 END AS inlier FROM t""")
def outlier_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(outliers.residual(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P))


_PAIR = "SELECT l_returnflag AS k, CAST(l_shipdate AS DATE) AS ds, sum(CAST(l_quantity AS DOUBLE)) AS a, sum(CAST(l_extendedprice AS DOUBLE)) AS b FROM lineitem GROUP BY ALL"


@query("outlier_joint", f"""WITH p AS (SELECT *, lag(a) OVER w AS x, lag(b) OVER w AS z FROM ({_PAIR}) WINDOW w AS (PARTITION BY k ORDER BY ds)),
  m AS (SELECT k, avg(a) AS ma, avg(b) AS mb, avg(x) AS mx, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(a, x) AS ax, covar_pop(a, z) AS az, covar_pop(b, x) AS bx, covar_pop(b, z) AS bz FROM p WHERE x IS NOT NULL GROUP BY k),
  r AS (SELECT p.*, a - ma - ((ax * zz - az * xz) * (x - mx) + (az * xx - ax * xz) * (z - mz)) / (xx * zz - xz * xz) AS r, b - mb - ((bx * zz - bz * xz) * (x - mx) + (bz * xx - bx * xz) * (z - mz)) / (xx * zz - xz * xz) AS q FROM p JOIN m USING (k)),
  s AS (SELECT k, covar_pop(r, r) AS rr, covar_pop(r, q) AS rq, covar_pop(q, q) AS qq FROM r GROUP BY k), e AS (SELECT r.*, (r * r * qq - 2 * r * q * rq + q * q * rr) / (rr * qq - rq * rq) AS e FROM r JOIN s USING (k)),
  t AS (SELECT *, avg(e) OVER (PARTITION BY k) + stddev_samp(e) OVER (PARTITION BY k) AS top FROM e) SELECT k, ds, round(a, 2) AS a, round(b, 2) AS b, CASE WHEN e IS NULL OR e < top THEN 1 ELSE -1 END AS inlier FROM t""")
def outlier_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which quantity and price of a return flag leave their joint course."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("k"), F.to_date("l_shipdate").alias("ds")).agg(F.sum(F.col("l_quantity").cast("double")).alias("a"), F.sum(F.col("l_extendedprice").cast("double")).alias("b"))
    return _out(outliers.joint_residual(rows, P, ["a", "b"]), digits=2)


@query("stationarity", f"WITH {_sql('orders')}, d AS ({MERGED['sum']}), p AS (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY ds) AS x FROM d), f AS (SELECT k, regr_slope(y - x, x) AS b, regr_sxx(y - x, x) AS sxx, regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy, regr_count(y - x, x) AS n FROM p GROUP BY k) SELECT k, round(b / sqrt((syy - b * sxy) / ((n - 2) * sxx)), 4) AS statistic, b / sqrt((syy - b * sxy) / ((n - 2) * sxx)) <= -2.86 AS stationary FROM f")
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(outliers.stationary(clean.deduplicated(_rows(spark, sf_dir), P, "sum"), P))


# The pipeline, classes and weeks

_CLEAN = (_IQR, "w AS (SELECT k, ds, CASE WHEN min(inlier) OVER (PARTITION BY k, ds) = 1 THEN y END AS y FROM o), d AS (SELECT k, ds, coalesce(sum(y), 0) AS y FROM w GROUP BY k, ds)", CALENDAR, _line(), "f AS (SELECT k, ds, coalesce(y, avg(y) OVER (PARTITION BY k)) AS y FROM l)")
_LIMITED = (f"d AS ({MERGED['median']})", CALENDAR, _line(2), "f AS (SELECT k, ds, coalesce(y, avg(y) OVER (PARTITION BY k)) AS y FROM l)")


@query("clean_pipeline", _chain(*_CLEAN, last="f"))
def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.cleansed(_rows(spark, sf_dir), P, "sum", "mean", {"method": "linear"}, "iqr"))


@query("clean_users", _chain(*_LIMITED, source="users", last="f"))
def clean_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(clean.cleansed(_rows(spark, sf_dir, "users"), P, "median", "mean", {"method": "linear", "limit": 2}))


_DEMAND = """t AS (SELECT k, CASE WHEN count(*) > 1 THEN date_diff('day', min(ds), max(ds)) / (count(*) - 1) END AS adi, CASE WHEN avg(y) = 0 THEN CASE WHEN var_samp(y) > 0 THEN CAST('inf' AS DOUBLE) END ELSE var_samp(y) / (avg(y) * avg(y)) END AS cv2, max(abs(y)) = 0 AS z FROM s GROUP BY k),
  x AS (SELECT k, adi, cv2, CASE WHEN z THEN 'Zero' WHEN adi <= 1.34 AND cv2 <= 0.49 THEN 'Smooth' WHEN adi >= 1.34 AND cv2 >= 0.49 THEN 'Lumpy' WHEN adi < 1.34 AND cv2 > 0.49 THEN 'Erratic' WHEN adi > 1.34 AND cv2 < 0.49 THEN 'Intermittent' ELSE 'Zero' END AS classification FROM t)"""
for _name, _source in (("classify_parts", "parts"), ("classify_users", "users"), ("classify_orders", "orders")):
    query(_name, f"WITH {_sql(_source)}, {_DEMAND} SELECT k, round(adi, 4) AS adi, round(cv2, 4) AS cv2, classification FROM x")(lambda s, d, src=_source: _out(demand.classified(_rows(s, d, src), P)))

_BY_CLASS = {"Smooth": {"duplicates": "sum", "fill": "zero"}, "Erratic": {"duplicates": "sum", "fill": "zero"}, "Intermittent": {"duplicates": "mean", "fill": "zero"}, "Lumpy": {"duplicates": "mean", "fill": "zero"}, "Zero": {"duplicates": "sum", "fill": "zero"}}


@query("clean_by_class", f"""WITH {_sql('users')}, {_DEMAND}, d AS (SELECT s.k, s.ds, CASE WHEN any_value(x.classification) IN ('Intermittent', 'Lumpy') THEN avg(s.y) ELSE sum(s.y) END AS y FROM s JOIN x ON x.k = s.k GROUP BY s.k, s.ds), {CALENDAR}
  SELECT k, ds, round(coalesce(y, 0), 4) AS y FROM c""")
def clean_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "users")
    return _out(clean.cleansed_by_class(rows, P, demand.classified(rows, P), _BY_CLASS))


for _day, _shift in (("MON", 1), ("SUN", 0)):
    query(f"weekly_{_day.lower()}", _chain(*_PIPE, _ZERO, f"w AS (SELECT k, CAST(ds - CAST((isodow(ds) - {_shift}) % 7 AS INTEGER) AS DATE) AS ds, sum(y) AS y FROM f GROUP BY ALL)", last="w"))(lambda s, d, day=_day: _out(rollup.weekly(clean.cleansed(_rows(s, d), P, "sum", "zero"), P, day)))


@query("clean_weekly", _chain(*_PIPE, _line(), "f AS (SELECT k, ds, coalesce(y, 0) AS y FROM l)", "w AS (SELECT k, CAST(ds - CAST(isodow(ds) - 1 AS INTEGER) AS DATE) AS ds, sum(y) AS y FROM f GROUP BY ALL)", last="w"))
def clean_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(rollup.weekly(clean.cleansed(_rows(spark, sf_dir), P, "sum", "zero", {"method": "linear"}), P))


@query("stream_hourly", f"WITH {_sql('events', True)} SELECT k, date_trunc('hour', ds) AS ds, round(sum(y), 4) AS y, count(y) AS n FROM s GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of streams, run here as a batch."""
    return _out(streamed(_rows(spark, sf_dir, "events", True), HOURS).withColumn("ds", F.col("ds").cast("timestamp_ntz")))


# Features

_DAILY = (*_PIPE, _ZERO)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleansed(_rows(spark, sf_dir), P, "sum", "zero")


_W = "WINDOW w AS (PARTITION BY k ORDER BY ds)"


@query("lags_3", f"WITH {', '.join([_sql(), *_DAILY])}, t AS (SELECT k, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3, row_number() OVER w AS i FROM f {_W}) SELECT k, ds, round(y, 4) AS y, round(lag_1, 4) AS lag_1, round(lag_2, 4) AS lag_2, round(lag_3, 4) AS lag_3 FROM t WHERE i > 3")
def lags_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(lags.lagged(_daily(spark, sf_dir), P, 3))


@query("rolling_predictor", f"WITH {', '.join([_sql(), *_DAILY])}, t AS (SELECT k, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean, max(y) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_max, row_number() OVER w AS i FROM f {_W}) SELECT k, ds, round(y, 4) AS y, round(lag_1, 4) AS lag_1, round(lag_2, 4) AS lag_2, round(rolling_mean, 4) AS rolling_mean, round(rolling_max, 4) AS rolling_max FROM t WHERE i > 7")
def rolling_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(lags.lagged(_daily(spark, sf_dir), P, 2, {"mean": 7, "max": 4}))


_MADE = {"month": "month(ds)", "week": "CASE WHEN day(ds) <= 7 THEN 0 WHEN day(ds) <= 22 THEN 1 ELSE 2 END", "dayofweek": "isodow(ds) - 1", "dayofmonth": "day(ds)", "weekofyear": "week(ds)"}
_TURNS = {"month": "month(ds) / 12", "week": f"({_MADE['week']}) / 3", "dayofweek": "(isodow(ds) - 1) / 7", "dayofmonth": "day(ds) / day(last_day(ds))", "weekofyear": "week(ds) / 52"}


@query("date_features", f"WITH {', '.join([_sql(), *_DAILY])} SELECT k, ds, {', '.join(f'CAST({v} AS INTEGER) AS {n}' for n, v in _MADE.items())} FROM f")
def date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.with_features(_daily(spark, sf_dir), "ds", list(_MADE)).drop("y")


@query("date_polar", f"WITH {', '.join([_sql(), *_DAILY])} SELECT k, ds, {', '.join(f'round({g}(2 * pi() * {v}), 6) + 0 AS {g}_{n}' for n, v in _TURNS.items() for g in ('sin', 'cos'))} FROM f")
def date_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dates.with_polar(_daily(spark, sf_dir), "ds", list(_TURNS)).drop("y")
    return table.select("k", "ds", *[(F.round(c, 6) + 0).alias(c) for c in table.columns if c not in ("k", "ds")])


@query("ts_features", f"""WITH {', '.join([_sql(), *_DAILY])}, a AS (SELECT k, ds, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n, lag(y) OVER w AS y1, min(y) OVER (PARTITION BY k) AS lo, max(y) OVER (PARTITION BY k) AS hi, CASE WHEN row_number() OVER w >= 10 THEN avg(y) OVER (w ROWS 9 PRECEDING) END AS m, CASE WHEN row_number() OVER w >= 10 THEN var_samp(y) OVER (w ROWS 9 PRECEDING) END AS v FROM f {_W}),
  b AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE greatest(ceil((y - lo) * 10 / (hi - lo)), 1) END AS bin, abs(m - lag(m, 10) OVER w) AS dm, abs(v - lag(v, 10) OVER w) AS dv, i // 10 AS seg FROM a {_W}),
  c2 AS (SELECT *, CASE WHEN lag(bin) OVER w = bin THEN 0 ELSE 1 END AS turn FROM b {_W}), r AS (SELECT k, sum(turn) OVER (PARTITION BY k ORDER BY ds ROWS UNBOUNDED PRECEDING) AS run FROM c2),
  r2 AS (SELECT k, max(c) AS flat_spots FROM (SELECT k, run, count(*) AS c FROM r GROUP BY k, run) GROUP BY k), g AS (SELECT k, var_pop(v) AS lumpiness FROM (SELECT k, seg, var_samp(y) AS v FROM b WHERE seg < n // 10 AND i % 10 <> 0 GROUP BY k, seg) GROUP BY k)
  SELECT b.k, round(corr(b.y, b.y1), 4) AS acf1, round(max(dm), 2) AS level_shift, round(max(dv) / 1e6, 2) AS variance_change, count(*) FILTER (WHERE i >= 1 AND y <= (hi - lo) / 2) AS crossing_median, any_value(r2.flat_spots) AS flat_spots, round(any_value(g.lumpiness) / 1e12, 2) AS lumpiness FROM b JOIN r2 ON r2.k = b.k JOIN g ON g.k = b.k GROUP BY b.k""")
def ts_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.featurized(_daily(spark, sf_dir), P)
    return t.select("k", F.round("acf1", 4).alias("acf1"), F.round("level_shift", 2).alias("level_shift"), F.round(F.col("variance_change") / 1e6, 2).alias("variance_change"), "crossing_median", "flat_spots", F.round(F.col("lumpiness") / 1e12, 2).alias("lumpiness"))


@query("cluster_series")
def cluster_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clusterized(clean.cleansed(_rows(spark, sf_dir, "users"), P, "sum", "zero"), P, k=4).select("k", "cluster")


# Metrics: yesterday's value as the forecast

_E = "1e-10"
_M = f"""b AS (SELECT k, ds, y AS a, lag(y) OVER w AS p FROM f {_W}), e AS (SELECT k, ds, a, p, a - p AS e FROM b WHERE p IS NOT NULL),
  v AS (SELECT *, lag(a) OVER w AS a1, lag(p) OVER w AS p1, avg(a) OVER (PARTITION BY k) AS mean FROM e {_W}),
  x AS (SELECT *, CASE WHEN a = 0 THEN CASE WHEN e = 0 THEN 0 ELSE 1 END ELSE abs(e) / a END AS pe, e / (a - a1 + {_E}) AS re, CASE WHEN a1 IS NOT NULL THEN abs(e) / (abs(e) + abs(a - a1) + {_E}) END AS bre, abs(a - a1) AS naive, CASE WHEN a1 IS NOT NULL THEN CAST(sign(a - a1) = sign(p - p1) AS DOUBLE) END AS same FROM v)"""
_SMAPE = f"2 * abs(e) / (abs(a) + abs(p) + {_E})"
_SCALES = {
    "mse": "avg(e * e)", "rmse": "sqrt(avg(e * e))", "nrmse": "sqrt(avg(e * e)) / (max(a) - min(a))", "me": "avg(e)", "mae": "avg(abs(e))", "mad": "avg(abs(e))", "wmape": f"sum(abs(e)) / (sum(a) + {_E})",
    "gmae": "exp(avg(ln(nullif(abs(e), 0))))", "mdae": "median(abs(e))", "mpe": "avg(pe)", "mape": "avg(abs(pe))", "mdape": "median(abs(pe))", "smape": f"avg({_SMAPE})", "smdape": f"median({_SMAPE})",
    "maape": f"avg(atan(abs(e / (a + {_E}))))", "mase": "avg(abs(e)) / avg(naive)", "std_ae": "sqrt((sum(e * e) - 2 * avg(abs(e)) * sum(e) + count(*) * avg(abs(e)) * avg(abs(e))) / (count(*) - 1))",
    "std_ape": "sqrt((sum(pe * pe) - 2 * avg(abs(pe)) * sum(pe) + count(*) * avg(abs(pe)) * avg(abs(pe))) / (count(*) - 1))", "rmspe": "sqrt(avg(pe * pe))", "rmdspe": "sqrt(median(pe * pe))", "rmsse": "sqrt(avg(e * e)) / avg(naive)",
    "inrse": f"sqrt(sum(e * e) / (sum((a - mean) * (a - mean)) + {_E}))", "rrse": f"sqrt(sum(e * e) / (sum((a - mean) * (a - mean)) + {_E}))", "mre": "avg(re)", "rae": f"sum(abs(e)) / (sum(abs(a - mean)) + {_E})", "mrae": "avg(abs(re))",
    "mdrae": "median(abs(re))", "gmrae": "exp(avg(ln(nullif(abs(re), 0))))", "mbrae": "avg(bre)", "umbrae": "avg(bre) / (1 - avg(bre))", "mda": "avg(same)",
}
#: Measures of huge relative errors (by differences of about 0) are compared in fewer digits.
_WIDE = ("mse", "mre", "mrae")


def _scaled(name: str) -> int:
    return -4 if name in _WIDE else 4


@query("metrics_all", f"WITH {', '.join([_sql('flags'), *_DAILY, _M])} SELECT k, {', '.join(f'round({v}, {_scaled(n)}) AS {n}' for n, v in _SCALES.items())} FROM x GROUP BY k")
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = clean.cleansed(_rows(spark, sf_dir, "flags"), P, "sum", "zero")
    rows = daily.withColumn("p", F.lag("y").over(P.ordered()))
    table = metrics.evaluated(rows, "y", "p", ["k"], "ds", "all")
    return table.select("k", *[F.round(m, _scaled(m)).alias(m) for m in metrics.METRICS])


@query("metrics_default", f"WITH {', '.join([_sql('orders'), *_DAILY, _M])} SELECT k, {', '.join(f'round({_SCALES[n]}, {_scaled(n)}) AS {n}' for n in metrics.DEFAULT)} FROM x GROUP BY k")
def metrics_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir).withColumn("p", F.lag("y").over(P.ordered()))
    table = metrics.evaluated(rows, "y", "p", ["k"], "ds")
    return table.select("k", *[F.round(m, _scaled(m)).alias(m) for m in metrics.DEFAULT])


# Hierarchies: customers in nations in regions

_NODES = "m AS (SELECT CAST(c.c_custkey AS VARCHAR) AS item, n.n_name AS nation, r.r_name AS region FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"
_SALES = "o AS (SELECT o_orderstatus AS local, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(o_custkey AS VARCHAR) AS item, o_totalprice AS y FROM orders)"


def _hierarchy(spark: SparkSession, sf_dir: str) -> hierarchy.Hierarchy:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    master = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    master = master.select(F.col("c_custkey").cast("string").alias("item"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return hierarchy.Hierarchy(master, {"item": "nation", "nation": "region", "region": "total"}, "item", "local", "ds", "y")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("local"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("ds"), F.col("o_custkey").cast("string").alias("item"), F.col("o_totalprice").alias("y"))


@query("hier_aggregate", f"WITH {_NODES}, {_SALES}, j AS (SELECT o.local, o.ds, o.y, m.* FROM o JOIN m ON m.item = o.item) SELECT local, ds, round(sum(y), 4) AS y, code FROM (SELECT local, ds, y, unnest([item, nation || '|nation', region || '|region', 'total']) AS code FROM j) GROUP BY local, ds, code")
def hier_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_hierarchy(spark, sf_dir).aggregated(_sales(spark, sf_dir)))


@query("hier_parents", f"WITH {_NODES} SELECT DISTINCT item AS child, nation || '|nation' AS parent FROM m UNION SELECT DISTINCT nation || '|nation', region || '|region' FROM m UNION SELECT DISTINCT region || '|region', 'total' FROM m")
def hier_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir).edges()


def _regions(spark: SparkSession, sf_dir: str, factor: float = 1.1) -> tuple[hierarchy.Hierarchy, DataFrame]:
    """Forecasts that do not add up: each region's month, and ``factor`` times their sum."""
    master = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("region"))
    tree = hierarchy.Hierarchy(master, {"region": "total"}, "region", "local", "ds", "y")
    deep = _hierarchy(spark, sf_dir)
    sums = _sales(spark, sf_dir).join(deep.master, "item").groupBy("local", "ds", F.col("region").alias("code")).agg(F.sum("y").alias("y"))
    top = sums.groupBy("local", "ds").agg((F.sum("y") * factor).alias("y")).select("local", "ds", F.lit("total").alias("code"), "y")
    return tree, sums.select("local", "ds", "code", "y").union(top)


_RECONCILED = f"WITH {_NODES}, {_SALES}, a AS (SELECT o.local, o.ds, m.region AS code, sum(o.y) AS y FROM o JOIN m ON m.item = o.item GROUP BY ALL), t AS (SELECT local, ds, sum(y) AS s, count(*) AS m, 0.1 * sum(y) / (count(*) + 1) AS d FROM a GROUP BY ALL) SELECT a.local, a.ds, a.code, round(a.y + t.d, 4) AS y FROM a JOIN t ON t.local = a.local AND t.ds = a.ds UNION ALL SELECT local, ds, 'total', round(s + m * d, 4) FROM t"


@query("hier_reconcile_ols2", _RECONCILED)
def hier_reconcile_ols2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, forecasts = _regions(spark, sf_dir)
    return _out(tree.reconciled_two_levels(forecasts))


#: A factor with which no value lies midway between two rounded ones.
_FACTOR = 1.1037


def _kept(spread: str) -> str:
    """Reconciliation of the regions that have a forecast in each month of their local; ``spread``: of what the total differs."""
    return f"""WITH {_NODES}, {_SALES}, a0 AS (SELECT o.local, o.ds, m.region AS code, sum(o.y) AS y FROM o JOIN m ON m.item = o.item GROUP BY ALL), t0 AS (SELECT local, ds, {_FACTOR} * sum(y) AS y FROM a0 GROUP BY ALL),
  a AS (SELECT a0.* FROM a0 JOIN (SELECT local, code FROM a0 GROUP BY local, code HAVING count(*) = (SELECT count(DISTINCT ds) FROM a0 b WHERE b.local = a0.local)) USING (local, code)),
  t AS (SELECT local, ds, sum(a.y) AS s, count(*) AS m, any_value(t0.y) - sum(a.y) AS d FROM a JOIN t0 USING (local, ds) GROUP BY ALL)
  SELECT a.local, a.ds, a.code, round(a.y + d * {spread}, 2) AS y FROM a JOIN t ON t.local = a.local AND t.ds = a.ds UNION ALL SELECT local, ds, 'total', round(s + m * d * {spread}, 2) FROM t"""


@query("hier_reconcile_struct", _kept("1.0 / (2 * m)"))
def hier_reconcile_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, forecasts = _regions(spark, sf_dir, _FACTOR)
    return _out(tree.reconciled(forecasts, "wls_struct"), digits=2)


_LATE = _kept("1.0 / (m + 1)").replace("FROM orders)", "FROM orders WHERE o_orderdate >= DATE '2000-01-01')")


@query("hier_reconciliation", f"SELECT local, ds, code, CASE WHEN code = 'total' THEN 'total' ELSE 'region' END AS code_type, y FROM ({_LATE})")
def hier_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front end: the past up to 1999, forecasts of later months under their usual name."""
    tree, sums = _regions(spark, sf_dir, _FACTOR)
    later = F.col("ds") >= F.lit("2000-01-01").cast("date")
    return _out(tree.reconciliation(sums.where(~later), sums.where(later).withColumnRenamed("y", "predictions")), digits=2)


def _years(spark: SparkSession, sf_dir: str) -> tuple[hierarchy.Hierarchy, DataFrame]:
    """A tree of nations, regions and their total, with yearly forecasts of each level that do not add up."""
    deep = _hierarchy(spark, sf_dir)
    tree = hierarchy.Hierarchy(deep.master.select("nation", "region").distinct(), {"nation": "region", "region": "total"}, "nation", "local", "ds", "y")
    sales = _sales(spark, sf_dir).join(deep.master, "item").withColumn("ds", F.to_date(F.date_trunc("year", "ds")))
    sums = tree.aggregated(sales.select("local", "ds", "nation", "y"))
    factor = F.when(F.col("code") == "total", _FACTOR).when(F.col("code").contains("|"), 1.0519).otherwise(1.0)
    return tree, sums.withColumn("y", F.col("y") * factor)


_TREE = f"""WITH {_NODES}, {_SALES}, n AS (SELECT o.local, date_trunc('year', o.ds) AS ds, m.nation, m.region, sum(o.y) AS y FROM o JOIN m ON m.item = o.item GROUP BY ALL),
  k AS (SELECT local, count(DISTINCT ds) AS n FROM n GROUP BY local), l AS (SELECT n.* FROM n JOIN (SELECT n.local, nation FROM n JOIN k USING (local) GROUP BY n.local, nation, k.n HAVING count(*) = k.n) USING (local, nation)),
  r0 AS (SELECT local, ds, region, 1.0519 * sum(y) AS y FROM n GROUP BY ALL), r1 AS (SELECT r0.* FROM r0 JOIN (SELECT r0.local, region FROM r0 JOIN k USING (local) GROUP BY r0.local, region, k.n HAVING count(*) = k.n) USING (local, region)),
  r AS (SELECT c.local, c.ds, c.region, c.e AS e0, c.v AS v0, CASE WHEN r1.y IS NULL THEN c.e ELSE (c.e * c.v + r1.y * c.v) / (2 * c.v) END AS e, CASE WHEN r1.y IS NULL THEN c.v ELSE c.v / 2 END AS v, r1.y IS NOT NULL AS own FROM (SELECT local, ds, region, sum(y) AS e, CAST(count(*) AS DOUBLE) AS v FROM l GROUP BY ALL) c LEFT JOIN r1 USING (local, ds, region)),
  t AS (SELECT c.local, c.ds, c.e AS e0, c.v AS v0, (c.e * c.w + y * c.v) / (c.v + c.w) AS x FROM (SELECT r.local, r.ds, sum(e) AS e, sum(v) AS v, sum(v0) AS w FROM r GROUP BY ALL) c JOIN (SELECT local, ds, {_FACTOR} * sum(y) AS y FROM n GROUP BY ALL) USING (local, ds)),
  rx AS (SELECT r.*, r.e + r.v / t.v0 * (t.x - t.e0) AS x FROM r JOIN t USING (local, ds)), lx AS (SELECT l.local, l.ds, l.nation, l.y + (rx.x - rx.e0) / rx.v0 AS x FROM l JOIN rx USING (local, ds, region))
  SELECT local, CAST(ds AS DATE) AS ds, code, round(x, 2) AS y FROM (SELECT local, ds, nation AS code, x FROM lx UNION ALL SELECT local, ds, region || '|region', x FROM rx WHERE own UNION ALL SELECT local, ds, 'total', x FROM t)"""


@query("hier_reconcile_tree", _TREE)
def hier_reconcile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, forecasts = _years(spark, sf_dir)
    return _out(tree.reconciled(forecasts, "wls_struct"), digits=2)


def _past_errors(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    tree, forecasts = _years(spark, sf_dir)
    later = F.col("ds") >= F.lit("2000-01-01").cast("date")
    return _out(tree.reconciliation(forecasts.where(~later), forecasts.where(later), method), digits=2)


QUERIES["hier_reconcile_var"] = lambda spark, sf_dir: _past_errors(spark, sf_dir, "wls_var")
QUERIES["hier_reconcile_shrink"] = lambda spark, sf_dir: _past_errors(spark, sf_dir, "mint_shrink")
QUERIES["hier_reconcile_cov"] = lambda spark, sf_dir: _past_errors(spark, sf_dir, "mint_cov")


# Forecasts of weekly orders

WEEKS = Panel("k", freq="7D")


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weekly(_daily(spark, sf_dir), P)


_WEEKLY = "w AS (SELECT k, CAST(ds - CAST(isodow(ds) - 1 AS INTEGER) AS DATE) AS ds, sum(y) AS y FROM f GROUP BY ALL)"


@query("regressor_ar1", f"""WITH RECURSIVE {', '.join([_sql(), *_DAILY, _WEEKLY])}, p AS (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY ds) AS x FROM w), g AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(ds) AS last, arg_max(y, ds) AS y0 FROM p GROUP BY k),
  h AS (SELECT k, a, b, last, 1 AS step, a + b * y0 AS y FROM g UNION ALL SELECT k, a, b, last, step + 1, a + b * y FROM h WHERE step < 4)
  SELECT k, CAST(last + 7 * step AS DATE) AS ds, round(y) AS predictions FROM h""")
def regressor_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "regressor", 4, {"lags": 1}), "k", "ds", "predictions", digits=0)


@query("croston", f"""WITH {_sql('users')}, d AS ({MERGED['sum']}), {CALENDAR}, f AS (SELECT k, ds, coalesce(y, 0) AS y FROM c), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ds) AS i FROM f),
  z AS (SELECT k, y, i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), 0) AS q, row_number() OVER (PARTITION BY k ORDER BY i) AS j, count(*) OVER (PARTITION BY k) AS n FROM i WHERE y <> 0),
  e AS (SELECT k, sum(y * CASE WHEN j = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - j) END) AS z, sum(q * CASE WHEN j = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - j) END) AS p FROM z GROUP BY k), l AS (SELECT k, max(ds) AS last FROM f GROUP BY k)
  SELECT l.k, CAST(l.last + 1 AS DATE) AS ds, round(coalesce(e.z / e.p, 0), 4) AS predictions FROM l LEFT JOIN e ON e.k = l.k""")
def croston(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(models.forecast(clean.cleansed(_rows(spark, sf_dir, "users"), P, "sum", "zero"), P, "croston"), "k", "ds", "predictions")


def _forecast(model: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, model, 4, **options), digits=2)


_PLACED = "r AS (SELECT k, ds, y, row_number() OVER (PARTITION BY k ORDER BY ds) AS i, count(*) OVER (PARTITION BY k) AS n FROM w), u AS (SELECT k, n, sum(y) / n AS mean, sum((i - 1 - (n - 1) / 2) * y) / (n * (n * n - 1.0) / 12) AS b, max(ds) AS last FROM r GROUP BY k, n)"
_STEPS = "f2 AS (SELECT unnest([1, 2, 3, 4]) AS step)"
_END = "CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS type_error"


def _points(**values: list[float]) -> str:
    """The grid of a search as SQL rows, in its order."""
    rows: list[dict[str, float]] = [{}]
    for name, options in values.items():
        rows = [r | {name: v} for r in rows for v in options]
    return f"g AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join([str(i), *(f'CAST({v} AS DOUBLE)' for v in r.values())]) + ')' for i, r in enumerate(rows))}) AS x(idx, {', '.join(values)}))"


def _searched(grid: str, start: str, step: str, loss: str, ahead: str) -> str:
    """A model fitted by a fold over weeks for each point of a grid; the point of least loss forecasts."""
    return f"""WITH RECURSIVE {', '.join([_sql(), *_DAILY, _WEEKLY, _PLACED, grid, _STEPS])},
  h AS (SELECT r.k, r.i, r.n, g.*, u.b AS slope, u.mean - u.b * (u.n - 1) / 2 AS level, {start} FROM r JOIN u ON u.k = r.k JOIN r r2 ON r2.k = r.k AND r2.i = 2, g WHERE r.i = 1
    UNION ALL SELECT h.k, h.i + 1, h.n, {', '.join(f'h.{c.strip()}' for c in grid.split('AS x(')[1].split(')')[0].split(','))}, h.slope, h.level, {step} FROM h JOIN r ON r.k = h.k AND r.i = h.i + 1),
  z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {loss}, idx) AS place FROM h WHERE i = n) WHERE place = 1)
  SELECT z.k, CAST(u.last + 7 * step AS DATE) AS ds, round({ahead}, 2) AS predictions, {_END} FROM z JOIN u ON u.k = z.k, f2"""


_E_ES = "(r.y - h.l - h.d)"
_BENT = "(h.theta * r.y + (1 - h.theta) * (h.level + h.slope * h.i))"  # h.i is one less than the row's number
_E_TH = "(r.y - ((1 - 1 / h.theta) * (h.level + h.slope * h.i) + h.l / h.theta))"
_TH = ("(g.theta * r.y + (1 - g.theta) * (u.mean - u.b * (u.n - 1) / 2)) AS l, CAST(0 AS DOUBLE) AS sse", f"h.l + h.alpha * ({_BENT} - h.l), h.sse + pow({_E_TH}, 2)", "sse", "(1 - 1 / theta) * (level + slope * (z.n - 1 + step)) + l / theta")
_FOURIER = f"""WITH {', '.join([_sql(), *_DAILY, _WEEKLY, _PLACED, _STEPS])}, t AS (SELECT r.k, r.i - 1 AS t, r.n, r.y - (u.mean + u.b * (r.i - 1 - (r.n - 1) / 2)) AS e FROM r JOIN u ON u.k = r.k),
  q AS (SELECT k, n, CAST(unnest(range(0, n // 2 + 1)) AS DOUBLE) AS j FROM (SELECT DISTINCT k, n FROM r)),
  c3 AS (SELECT q.k, q.n, q.j, sum(e * cos(2 * pi() * j * t / q.n)) AS re, -sum(e * sin(2 * pi() * j * t / q.n)) AS im FROM q JOIN t ON t.k = q.k GROUP BY q.k, q.n, q.j),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY re * re + im * im DESC, j) AS place FROM c3) WHERE place <= 10),
  p2 AS (SELECT b.k, f2.step, sum(CASE WHEN j = 0 OR 2 * j = n THEN 1.0 ELSE 2.0 END / n * (re * cos(2 * pi() * j * (n - 1 + step) / n) - im * sin(2 * pi() * j * (n - 1 + step) / n))) AS s FROM best b, f2 GROUP BY b.k, f2.step)
  SELECT u.k, CAST(u.last + 7 * step AS DATE) AS ds, round(u.mean + u.b * ((u.n - 1) / 2 + step) + s, 2) AS predictions, {_END} FROM u JOIN p2 ON p2.k = u.k"""
_FORECAST_SQL = {
    "exponential_smoothing": _searched(_points(alpha=models.ALPHAS, beta=[0.0, 0.05, 0.1, 0.3]), "r.y AS l, r2.y - r.y AS d, CAST(0 AS DOUBLE) AS sse", f"h.l + h.d + h.alpha * {_E_ES}, h.d + h.alpha * h.beta * {_E_ES}, h.sse + pow({_E_ES}, 2)", "sse", "l + step * d"),
    "theta": _searched(_points(theta=[2.0], alpha=models.ALPHAS), *_TH),
    "four_theta": _searched(_points(theta=[1.0, 1.5, 2.0, 3.0], alpha=models.ALPHAS), *_TH),
    "kalman": _searched(
        _points(ratio=[0.0, 0.001, 0.01, 0.1, 0.3, 1.0, 3.0, 10.0]), "r.y AS l, CAST(1 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ss, CAST(0 AS DOUBLE) AS logs",
        "h.l + (h.p + h.ratio) / (h.p + h.ratio + 1) * (r.y - h.l), (h.p + h.ratio) * (1 - (h.p + h.ratio) / (h.p + h.ratio + 1)), h.ss + (r.y - h.l) * (r.y - h.l) / (h.p + h.ratio + 1), h.logs + ln(h.p + h.ratio + 1)",
        "greatest(n - 1, 1) * ln(greatest(ss / greatest(n - 1, 1), 1e-300)) + logs", "l",
    ),
    "fast_fourier_transform": _FOURIER,
}
for _model in ("fast_fourier_transform", "exponential_smoothing", "arima_univariate", "four_theta", "theta", "autoarima_univariate", "kalman", "prophet", "random_forest", "lgbm"):
    query(f"forecast_{_model}", _FORECAST_SQL.get(_model))(_forecast(_model))
QUERIES["forecast_arima_errors"] = lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "arima_univariate", 4, {"p": 2, "d": 1, "q": 2}), digits=2)
QUERIES["forecast_holt_winters"] = lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "exponential_smoothing", 4, {"season": 13}), digits=2)
QUERIES["forecast_theta_seasonal"] = lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "theta", 4, {"season": 13}), digits=2)
QUERIES["probabilistic_exponential_smoothing"] = _forecast("exponential_smoothing", samples=20)
QUERIES["probabilistic_kalman_slope"] = lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "kalman", 4, {"slope": True}, samples=20), digits=2)
QUERIES["forecast_autoarima_errors"] = lambda spark, sf_dir: _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "autoarima_univariate", 4, {"p": 2, "q": 2}), digits=2)
QUERIES["probabilistic_random_forest"] = _forecast("random_forest", samples=20)
QUERIES["probabilistic_regressor"] = _forecast("regressor", samples=20)


QUERIES["probabilistic_bootstrap"] = lambda spark, sf_dir: _out(bootstrap_interval(_weekly(spark, sf_dir), WEEKS, 3, 2), digits=2)


def _calendar(spark: SparkSession, weeks: DataFrame) -> DataFrame:
    """A covariate for each week, past and to come: the month's sine."""
    days = weeks.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", 70), F.expr("interval 7 days"))).alias("ds"))
    month: Column = F.sin(2 * F.pi() * F.month("ds") / 12)
    return days.select("ds", month.alias("season"))


@query("forecast_regressor_covariates")
def forecast_regressor_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _weekly(spark, sf_dir)
    return _out(models.forecast(weeks, WEEKS, "regressor", 4, {"lags": 3}, _calendar(spark, weeks)), digits=2)


for _name, _extra in (("arima", {}), ("autoarima", {}), ("regressor_darts", {}), ("statsforecast_autoarima", {"samples": 20})):

    def _covariates(spark: SparkSession, sf_dir: str, model: str = _name, extra: dict = _extra) -> DataFrame:
        weeks = _weekly(spark, sf_dir)
        return _out(models.forecast(weeks, WEEKS, model, 4, None, _calendar(spark, weeks), **extra), digits=2)

    QUERIES[f"forecast_{_name}"] = _covariates


class LeastSquares:
    """The plainest estimator with fit and predict."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.coef = np.linalg.lstsq(np.column_stack((np.ones(len(x)), x)), y, rcond=None)[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.coef[0] + x @ self.coef[1:]


@query("regressor_estimator", ORACLES["regressor_ar1"])
def regressor_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any estimator, here least squares: the result is that of the built-in one."""
    return _out(models.forecast(_weekly(spark, sf_dir), WEEKS, "regressor", 4, {"lags": 1, "estimator": LeastSquares()}), "k", "ds", "predictions", digits=0)


@query("regressor_estimator_interval")
def regressor_estimator_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _weekly(spark, sf_dir)
    return _out(models.forecast(weeks, WEEKS, "regressor", 2, {"lags": 3, "estimator": LeastSquares()}, _calendar(spark, weeks), samples=20), digits=2)


@query("ts_trend_features", f"""WITH {', '.join([_sql(), *_DAILY])}, t AS (SELECT k, y, CAST(row_number() OVER w - 1 AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY k) AS DOUBLE) AS n, avg(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS tr FROM f {_W}),
  x AS (SELECT *, y - tr AS r, i - (n - 1) / 2 AS x, pow(i - (n - 1) / 2, 2) - (n * n - 1) / 12 AS q FROM t), o AS (SELECT *, ((sum(r * r) OVER p - r * r) - pow(sum(r) OVER p - r, 2) / (n - 1)) / (n - 2) AS o FROM x WINDOW p AS (PARTITION BY k))
  SELECT k, round(sum(tr * x) / sqrt(sum(x * x)), 2) AS linearity, round(sum(tr * q) / sqrt(sum(q * q)), 2) AS curvature, round(greatest(0, least(1, 1 - var_pop(r) / var_pop(y))), 6) AS trend, round(var_pop(o) / 1e12, 2) AS spikiness FROM o GROUP BY k""")
def ts_trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.featurized(_daily(spark, sf_dir), P)
    return t.select("k", F.round("linearity", 2).alias("linearity"), F.round("curvature", 2).alias("curvature"), F.round("trend", 6).alias("trend"), F.round(F.col("spikiness") / 1e12, 2).alias("spikiness"))


@query("trend_smoothed")
def trend_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's days on a penalised smoother."""
    return _out(smoothing.smoothed(_daily(spark, sf_dir), P))


@query("features_smoothed")
def features_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each priority's days, with the smoother's trend."""
    return _out(features.featurized(_daily(spark, sf_dir), P, smoother="spline"))


_DECOMPOSED = f"""{', '.join([_sql(), *_DAILY])}, t AS (SELECT k, ds, y, (row_number() OVER w - 1) % 7 AS p, CASE WHEN count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS tr FROM f {_W}),
  a AS (SELECT k, p, avg(y - tr) AS s FROM t GROUP BY k, p), b AS (SELECT k, p, s - avg(s) OVER (PARTITION BY k) AS seasonal FROM a)"""


@query("ts_decomposed", f"WITH {_DECOMPOSED} SELECT t.k, ds, round(y, 4) AS y, round(tr, 4) AS trend, round(seasonal, 4) AS seasonal, round(y - tr - seasonal, 4) AS rest FROM t JOIN b ON b.k = t.k AND b.p = t.p")
def ts_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(features.decomposed(_daily(spark, sf_dir), P, 7))


@query("ts_strengths", f"WITH {_DECOMPOSED}, d2 AS (SELECT t.k, y, tr, seasonal, y - tr - seasonal AS r FROM t JOIN b ON b.k = t.k AND b.p = t.p WHERE tr IS NOT NULL) SELECT k, round(greatest(0, least(1, 1 - var_pop(r) / var_pop(y - seasonal))), 6) AS trend, round(greatest(0, least(1, 1 - var_pop(r) / var_pop(y - tr))), 6) AS seasonality FROM d2 GROUP BY k")
def ts_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strengths(_daily(spark, sf_dir), P, 7).select("k", F.round("trend", 6).alias("trend"), F.round("seasonality", 6).alias("seasonality"))


@query("ts_polynomials", f"WITH {', '.join([_sql(), *_DAILY, _WEEKLY])}, t AS (SELECT k, ds, count(*) OVER (PARTITION BY k) AS n, row_number() OVER w - 1 - (count(*) OVER (PARTITION BY k) - 1) / 2 AS x FROM w {_W}), v AS (SELECT k, ds, x AS a, x * x - (n * n - 1.0) / 12 AS b, x * x * x - x * (3.0 * n * n - 7) / 20 AS c FROM t) SELECT k, ds, {', '.join(f'round({c} / sqrt(sum({c} * {c}) OVER (PARTITION BY k)), 6) + 0 AS p{i}' for i, c in enumerate('abc', 1))} FROM v")
def ts_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.polynomials(_weekly(spark, sf_dir), WEEKS, 3)
    return made.select("k", "ds", *[(F.round(f"p{i}", 6) + 0).alias(f"p{i}") for i in (1, 2, 3)])


def _grubbs_sql() -> str:
    poly = lambda x, c: "(" * (len(c) - 1) + str(c[0]) + "".join(f") * {x} + {v}" for v in c[1:])
    a, b, c, d = outliers.NORMAL
    z = f"CASE WHEN p <= 0.97575 THEN ({poly('q2', a)}) * q / (({poly('q2', b)}) * q2 + 1) ELSE -({poly('far', c)}) / (({poly('far', d)}) * far + 1) END"
    t = "z + (pow(z, 3) + z) / 4 / f + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(f, 2) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(f, 3) + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / 92160 / pow(f, 4)"
    return f"""WITH {_sql('events', True)}, a AS (SELECT k, greatest(max(y) - avg(y), avg(y) - min(y)) / stddev_samp(y) AS statistic, CAST(count(y) AS DOUBLE) AS n FROM s GROUP BY k),
  b AS (SELECT *, 1 - 0.05 / (2 * n) AS p, n - 2 AS f FROM a), c AS (SELECT *, p - 0.5 AS q, pow(p - 0.5, 2) AS q2, sqrt(-2 * ln(1 - p)) AS far FROM b), d AS (SELECT *, {z} AS z FROM c), e AS (SELECT *, {t} AS t FROM d), g AS (SELECT *, (n - 1) / sqrt(n) * sqrt(t * t / (n - 2 + t * t)) AS critical FROM e)
  SELECT k, round(statistic, 4) AS statistic, round(critical, 4) AS critical, statistic >= critical AS outlier FROM g"""


@query("grubbs", _grubbs_sql())
def grubbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(outliers.grubbs(_rows(spark, sf_dir, "events", True), P))


@query("outlier_corrected")
def outlier_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales by return flag, with outliers of the larger set capped."""
    daily = clean.completed(clean.deduplicated(_rows(spark, sf_dir, "flags"), P, "sum"), P)
    return _out(outliers.corrected(daily, P, eps=40.0))


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.isolation_forest(_rows(spark, sf_dir, "users", True), P)


@query("forecast_by_class")
def forecast_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "users")
    daily = clean.cleansed(rows, P, "sum", "zero")
    plans = {"Smooth": {"model": "exponential_smoothing"}, "Erratic": {"model": "theta"}, "Intermittent": {"model": "croston"}, "Lumpy": {"model": "croston"}, "Zero": {"model": "croston"}}
    return _out(models.forecast_by_class(daily, P, demand.classified(rows, P), plans, 2))
