"""Registered queries of the library's operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.grid import Grid
from ..operators import features, forecast, horizon, regression, validation, vectors
from ..schemas import availability_holds, clearing_holds, constraint_holds, dead_letter_holds, finite, settlement_holds
from ..series import LOAD, PRICE, Series
from ..sources import documents, store, tabular
from . import source_queries
from .fixtures import CUTOFFS, HOUR_US, LOAD_SQL, PRICE_SQL, RAW_SQL, load_hourly, load_raw, price_daily, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOURLY = Grid(HOUR_US)
TWO_HOURS = Grid(2 * HOUR_US)


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _rounded(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def _decimals(rows: DataFrame, *names: str) -> DataFrame:
    """Decimal results as decimals of three digits behind the point, never by way of a double."""
    return rows.withColumns({n: F.round(F.col(n).cast("decimal(38,12)"), 3).cast("decimal(18,3)") for n in names})


_DECIMAL_SQL = "CAST(round({0}, 3) AS DECIMAL(18,3)) AS {0}"


# --- lag features, splits, fits, predictions, errors and comparisons, for loads and prices alike

HISTORY = {LOAD: (load_hourly, LOAD_SQL), PRICE: (price_daily, PRICE_SQL)}


#: Decimals of fitted values; prices are larger by five orders of magnitude.
DIGITS = {LOAD: 6, PRICE: 3}


def _lag_sql(series: Series, hours: tuple[int, ...], rounded: bool = False) -> str:
    source = HISTORY[series][1]
    keys = ", ".join(series.keys)
    show = (lambda x, n: f"round(CAST({x} AS DOUBLE), 6) AS {n}") if rounded else (lambda x, n: f"{x} AS {n}")
    joins = " ".join(f"JOIN {source} l{h} ON {' AND '.join(f'l{h}.{k} = t.{k}' for k in series.keys)} AND l{h}.timestamp = t.timestamp - INTERVAL {h} HOUR" for h in hours)
    lags = ", ".join(show(f"l{h}.{series.value}", f"lag_{h}h") for h in hours)
    return f"SELECT {', '.join(f't.{k}' for k in keys.split(', '))}, t.timestamp, {lags}, {show('t.' + series.value, 'target')} FROM {source} t {joins}"


def _fit_sql(series: Series, rows: str, two: bool) -> str:
    keys = ", ".join(series.keys)
    x, z, y = "CAST(lag_24h AS DOUBLE)", "CAST(lag_168h AS DOUBLE)", "CAST(target AS DOUBLE)"
    if not two:
        return f"""SELECT *, CASE WHEN status = 'ok' THEN my - slope * mx END AS intercept FROM (SELECT *, CASE WHEN status = 'ok' THEN xy / xx END AS slope FROM (SELECT *, CASE WHEN n < 2 THEN 'insufficient' WHEN xx = 0 THEN 'singular' ELSE 'ok' END AS status FROM
            (SELECT {keys}, count(*) AS n, var_pop({x}) AS xx, covar_pop({x}, {y}) AS xy, avg({x}) AS mx, avg({y}) AS my FROM ({rows}) WHERE part = 'train' GROUP BY {keys})))"""
    return f"""SELECT *, CASE WHEN status = 'ok' THEN my - b1 * ma - b2 * mb END AS intercept FROM (SELECT *, CASE WHEN status = 'ok' THEN (ay * bb - by_ * ab) / det END AS b1, CASE WHEN status = 'ok' THEN (by_ * aa - ay * ab) / det END AS b2 FROM
        (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN det <= 0 THEN 'singular' ELSE 'ok' END AS status FROM (SELECT *, aa * bb - ab * ab AS det FROM
        (SELECT {keys}, count(*) AS n, var_pop({x}) AS aa, var_pop({z}) AS bb, covar_pop({x}, {z}) AS ab, covar_pop({x}, {y}) AS ay, covar_pop({z}, {y}) AS by_, avg({x}) AS ma, avg({z}) AS mb, avg({y}) AS my FROM ({rows}) WHERE part = 'train' GROUP BY {keys}))))"""


def _register(series: Series) -> None:
    name, keys, digits = series.name, list(series.keys), DIGITS[series]
    history = HISTORY[series][0]
    group = ", ".join(keys)
    lags = {1: (24,), 2: (24, 168)}

    def rows(n: int) -> Query:
        return lambda spark, d: features.split(features.lag_features(history(spark, d), series, lags[n]), series, CUTOFFS[series])

    split_sql = {n: f"SELECT *, CASE WHEN timestamp < TIMESTAMP '{CUTOFFS[series]}' THEN 'train' ELSE 'evaluation' END AS part FROM ({_lag_sql(series, lags[n])})" for n in lags}
    fit_sql = {n: _fit_sql(series, split_sql[n], n == 2) for n in lags}

    def add(key: str, function: Query, sql: str) -> None:
        query(f"{name}_{key}", sql)(function)

    for n, suffix in ((1, "lag24"), (2, "lag24_168")):
        shown = [f"lag_{h}h" for h in lags[n]] + ["target"]
        add(suffix, lambda s, d, n=n, shown=shown: _rounded(features.lag_features(history(s, d), series, lags[n]), *shown), _lag_sql(series, lags[n], rounded=True))
        add("split" if n == 1 else "split2", lambda s, d, n=n: rows(n)(s, d).groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), f"SELECT {group}, part, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM ({split_sql[n]}) GROUP BY ALL")
        fit = lambda t, series=series, n=n: regression.fit(t, series, n)
        shown = ["slope", "intercept"] if n == 1 else ["b1", "b2", "intercept"]
        train = lambda s, d, n=n: rows(n)(s, d).filter("part = 'train'")
        add(f"ols{n}", lambda s, d, fit=fit, train=train, shown=shown: _rounded(fit(train(s, d)), *shown, digits=digits), f"SELECT {group}, n, {', '.join(f'round({c}, {digits}) AS {c}' for c in shown)}, status FROM ({fit_sql[n]})")
        value = "slope * CAST(lag_24h AS DOUBLE) + intercept" if n == 1 else "intercept + b1 * CAST(lag_24h AS DOUBLE) + b2 * CAST(lag_168h AS DOUBLE)"
        predicted_sql = f"SELECT {', '.join('r.' + k for k in keys)}, timestamp, {value} AS predicted, CAST(target AS DOUBLE) AS actual FROM ({split_sql[n]}) r JOIN ({fit_sql[n]}) f USING ({group}) WHERE part = 'evaluation' AND status = 'ok'"

        def predictions(s, d, n=n, fit=fit):
            marked = rows(n)(s, d)
            return regression.predict(fit(marked.filter("part = 'train'")), marked.filter("part = 'evaluation'"), series)

        add(f"pred{n}", lambda s, d, p=predictions: _rounded(p(s, d), "predicted", "actual", digits=digits), f"SELECT {group}, timestamp, round(predicted, {digits}) AS predicted, round(actual, {digits}) AS actual FROM ({predicted_sql})")
        add(f"mae{n}", lambda s, d, p=predictions: _rounded(regression.mean_absolute_error(p(s, d), series), "mae", digits=digits), f"SELECT {group}, count(*) AS n, round(avg(abs(predicted - actual)), {digits}) AS mae FROM ({predicted_sql}) GROUP BY ALL")

        if series == PRICE:
            add(f"ols{n}_dec", lambda s, d, fit=fit, train=train, shown=shown: _decimals(fit(train(s, d)), *shown), f"SELECT {group}, n, {', '.join(_DECIMAL_SQL.format(c) for c in shown)}, status FROM ({fit_sql[n]})")
            add(f"pred{n}_dec", lambda s, d, p=predictions: _decimals(p(s, d), "predicted", "actual"), f"SELECT {group}, timestamp, {_DECIMAL_SQL.format('predicted')}, {_DECIMAL_SQL.format('actual')} FROM ({predicted_sql})")
            add(f"mae{n}_dec", lambda s, d, p=predictions: _decimals(regression.mean_absolute_error(p(s, d), series), "mae"), f"SELECT {group}, n, {_DECIMAL_SQL.format('mae')} FROM (SELECT {group}, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM ({predicted_sql}) GROUP BY ALL)")

    cases_sql = f"SELECT {group}, timestamp, lag_24h AS predicted, target AS actual FROM ({_lag_sql(series, (24,))})"
    add("persist_bt", lambda s, d: _rounded(features.persistence_cases(history(s, d), series), "predicted", "actual"), f"SELECT {group}, timestamp, round(CAST(predicted AS DOUBLE), 6) AS predicted, round(CAST(actual AS DOUBLE), 6) AS actual FROM ({cases_sql})")
    add("persist_mae", lambda s, d: _rounded(regression.mean_absolute_error(features.persistence_cases(history(s, d), series), series), "mae"), f"SELECT {group}, count(*) AS n, round(CAST(sum(abs(predicted - actual)) AS DOUBLE) / count(*), 6) AS mae FROM ({cases_sql}) GROUP BY ALL")

    for key, models in {"cmp_p_1": ("persistence", "ols1"), "cmp_1_2": ("ols1", "ols2"), "cmp_p_2": ("persistence", "ols2"), "cmp_3way": ("persistence", "ols1", "ols2")}.items():
        n = 2 if "ols2" in models else 1
        one, two = _fit_sql(series, split_sql[n], False), _fit_sql(series, split_sql[n], True) if n == 2 else None
        error = {"persistence": "abs(CAST(lag_24h AS DOUBLE) - CAST(target AS DOUBLE))", "ols1": "abs(f1.slope * CAST(lag_24h AS DOUBLE) + f1.intercept - CAST(target AS DOUBLE))", "ols2": "abs(f2.intercept + f2.b1 * CAST(lag_24h AS DOUBLE) + f2.b2 * CAST(lag_168h AS DOUBLE) - CAST(target AS DOUBLE))"}
        joins = (f" LEFT JOIN (SELECT * FROM ({one}) WHERE status = 'ok') f1 ON {' AND '.join(f'f1.{k} = r.{k}' for k in keys)}" if "ols1" in models else "") + (f" LEFT JOIN (SELECT * FROM ({two}) WHERE status = 'ok') f2 ON {' AND '.join(f'f2.{k} = r.{k}' for k in keys)}" if "ols2" in models else "")
        absent = " OR ".join(f"{error[m]} IS NULL" for m in models)
        sql = f"SELECT {', '.join('r.' + k for k in keys)}, count(*) AS n, {', '.join(f'round(avg({error[m]}), {digits}) AS mae_{m}' for m in models)}, count(CASE WHEN {absent} THEN 1 END) AS misaligned FROM ({split_sql[n]}) r{joins} WHERE part = 'evaluation' GROUP BY {', '.join('r.' + k for k in keys)}"
        add(key, lambda s, d, n=n, models=models: _rounded(regression.backtest(rows(n)(s, d), series, models), *[f"mae_{m}" for m in models], digits=digits), sql)
        if series == PRICE:
            add(f"{key}_dec", lambda s, d, n=n, models=models: _decimals(regression.backtest(rows(n)(s, d), series, models), *[f"mae_{m}" for m in models]), f"SELECT {group}, n, {', '.join(_DECIMAL_SQL.format(f'mae_{m}') for m in models)}, misaligned FROM ({sql})")

    # forecasts of the evaluation instants a day and a week past the last fit's rows
    def targets(s, d):
        return history(s, d).select(*series.row).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '24' HOUR"))

    targets_sql = f"SELECT {group}, timestamp + INTERVAL 24 HOUR AS timestamp FROM {HISTORY[series][1]}"
    at = lambda h: f"LEFT JOIN {HISTORY[series][1]} l{h} ON {' AND '.join(f'l{h}.{k} = t.{k}' for k in keys)} AND l{h}.timestamp = t.timestamp - INTERVAL {h} HOUR"
    shown = "round(CAST(l24.{0} AS DOUBLE), 6)"
    add("persist_fc", lambda s, d: _rounded(forecast.persistence(targets(s, d), history(s, d), series), "predicted"), f"SELECT {', '.join('t.' + k for k in keys)}, t.timestamp, {shown.format(series.value)} AS predicted, CASE WHEN l24.timestamp IS NULL THEN 'missing' ELSE 'ok' END AS status FROM ({targets_sql}) t {at(24)}")

    def ols_forecast(s, d):
        fit = regression.fit(rows(2)(s, d).filter("part = 'train'"), series, 2)
        return forecast.ols(targets(s, d), history(s, d), fit, series)

    value = f"f.intercept + f.b1 * CAST(l24.{series.value} AS DOUBLE) + f.b2 * CAST(l168.{series.value} AS DOUBLE)"
    negative = f"WHEN {value} < 0 THEN 'negative' " if series == LOAD else ""
    ols_sql = f"SELECT {group}, timestamp, CASE WHEN status = 'ok' THEN round(v, {digits}) END AS predicted, status FROM (SELECT {', '.join('t.' + k for k in keys)}, t.timestamp, {value} AS v, CASE WHEN l24.timestamp IS NULL THEN 'missing_24h' WHEN l168.timestamp IS NULL THEN 'missing_168h' WHEN f.b1 IS NULL THEN 'unfitted' {negative}ELSE 'ok' END AS status FROM ({targets_sql}) t {at(24)} {at(168)} LEFT JOIN (SELECT * FROM ({fit_sql[2]}) WHERE status = 'ok') f ON {' AND '.join(f'f.{k} = t.{k}' for k in keys)})"
    add("ols_fc", lambda s, d: _rounded(ols_forecast(s, d), "predicted", digits=digits), ols_sql)
    if series == PRICE:
        add("ols_fc_dec", lambda s, d: _decimals(ols_forecast(s, d), "predicted"), f"SELECT {group}, timestamp, {_DECIMAL_SQL.format('predicted')}, status FROM ({ols_sql})")


for _series in (LOAD, PRICE):
    _register(_series)


# --- series validation


@query("check_single_entity", f"SELECT CAST(count(DISTINCT consumer_id) AS BIGINT) AS entities, count(DISTINCT consumer_id) > 1 AS mixed FROM {RAW_SQL}")
def check_single_entity(spark, d):
    return validation.entities(load_raw(spark, d))


@query("grid_aligned", f"SELECT consumer_id, timestamp, (epoch_us(timestamp) % {2 * HOUR_US}) = 0 AS aligned FROM {LOAD_SQL}")
def grid_aligned(spark, d):
    return load_hourly(spark, d).select("consumer_id", "timestamp", TWO_HOURS.aligned(F.col("timestamp")).alias("aligned"))


@query("check_unique_ts", f"SELECT consumer_id, timestamp, count(*) AS n FROM {RAW_SQL} GROUP BY ALL HAVING count(*) > 1")
def check_unique_ts(spark, d):
    return validation.repeated_instants(load_raw(spark, d))


@query("check_chronology", f"SELECT consumer_id, min(pos) AS pos, arg_min(violation, pos) AS violation FROM (SELECT consumer_id, pos, CASE WHEN timestamp = b THEN 'duplicate' ELSE 'out_of_order' END AS violation FROM (SELECT *, lag(timestamp) OVER (PARTITION BY consumer_id ORDER BY pos) AS b FROM {RAW_SQL}) WHERE b >= timestamp) GROUP BY ALL")
def check_chronology(spark, d):
    return validation.chronology(load_raw(spark, d))


_ISSUES_SQL = f"(SELECT *, CASE WHEN count(*) OVER (PARTITION BY consumer_id, timestamp) > 1 THEN 'duplicate' WHEN (epoch_us(timestamp) % {2 * HOUR_US}) <> 0 THEN 'misaligned' END AS issue FROM {RAW_SQL})"


@query("series_validate", f"SELECT pos, consumer_id, timestamp, value_mw, issue FROM {_ISSUES_SQL}")
def series_validate(spark, d):
    return validation.issues(load_raw(spark, d), TWO_HOURS).select("pos", "consumer_id", "timestamp", "value_mw", "issue")


@query("dup_reject", f"SELECT pos, consumer_id, timestamp FROM {_ISSUES_SQL} WHERE issue = 'duplicate'")
def dup_reject(spark, d):
    return validation.issues(load_raw(spark, d)).filter("issue = 'duplicate'").select("pos", "consumer_id", "timestamp")


@query("dlq_rows", f"SELECT 'events:row:' || pos AS record_id, 'csv://events/row/' || pos AS payload_reference, 'series_' || issue AS code FROM {_ISSUES_SQL} WHERE issue IS NOT NULL")
def dlq_rows(spark, d):
    return validation.dead_letters(validation.issues(load_raw(spark, d), TWO_HOURS), "events")


@query("gap_detect", f"SELECT consumer_id, timestamp + INTERVAL 1 HOUR AS first_missing, nx - INTERVAL 1 HOUR AS last_missing, k - 1 AS missing, (k - 1) || CASE WHEN k = 2 THEN ' interval is missing' ELSE ' intervals are missing' END AS message FROM (SELECT *, (epoch_us(nx) - epoch_us(timestamp)) // {HOUR_US} AS k FROM (SELECT *, lead(timestamp) OVER (PARTITION BY consumer_id ORDER BY timestamp) AS nx FROM {LOAD_SQL})) WHERE k > 1")
def gap_detect(spark, d):
    return validation.gaps(load_hourly(spark, d), HOURLY)


# --- ingestion


def _cells(spark, d):
    """Readings as a file's rows: some short, some with impossible cells."""
    raw = load_raw(spark, d)
    time = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("pos") % 3 == 0, "+04:00").otherwise("Z"))
    value = F.when(F.col("pos") % 11 == 0, "12.5d").otherwise(F.round("value_mw", 3).cast("string"))
    cells = F.array(F.col("consumer_id"), time, value)
    return raw.select("pos", F.when(F.col("pos") % 7 == 0, F.slice(cells, 1, 2)).otherwise(cells).alias("cells"))


_ROWS_SQL = "(SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS consumer_id, date_trunc('hour', ts) - CASE WHEN event_id % 3 = 0 THEN INTERVAL 4 HOUR ELSE INTERVAL 0 HOUR END AS timestamp, round(value, 3) AS value_mw, CASE WHEN event_id % 7 = 0 THEN 'row_shape_invalid' WHEN event_id % 11 = 0 OR value < 0 THEN 'row_validation_failed' END AS code FROM events)"
_COLUMNS = {"consumer_id": 0, "timestamp": 1, "value_mw": 2}


@query("row_route", f"SELECT pos, code FROM {_ROWS_SQL}")
def row_route(spark, d):
    return tabular.route(_cells(spark, d), 3, _COLUMNS).select("pos", "code")


@query("ingest_project", f"SELECT pos, consumer_id, timestamp, value_mw FROM {_ROWS_SQL} WHERE code IS NULL")
def ingest_project(spark, d):
    return tabular.route(_cells(spark, d), 3, _COLUMNS).filter("code is null").drop("code")


@query("norm_power", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR value < 0 THEN NULL ELSE CAST(round(value, 3) AS DOUBLE) END AS mw, CASE WHEN event_id % 5 = 0 OR value < 0 THEN NULL ELSE CAST(CAST(round(value, 3) AS DECIMAL(38,12)) / 1000 AS DOUBLE) END AS from_kw FROM events")
def norm_power(spark, d):
    text = F.concat(F.lit(" "), F.round("value", 3).cast("string"), F.when(F.col("event_id") % 5 == 0, "f").otherwise(" "))
    return table(spark, d, "events").select("event_id", normalize.power_mw(text, "MW").alias("mw"), normalize.power_mw(text, "kW").alias("from_kw"))


@query("norm_timestamp", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 4 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) END AS utc FROM events")
def norm_timestamp(spark, d):
    plain, compact = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyyMMdd'T'HHmmss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(plain, F.lit("+04:00"))).when(F.col("event_id") % 4 == 1, F.concat(compact, F.lit("Z"))).when(F.col("event_id") % 4 == 2, plain).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", normalize.timestamp_utc(text, "UTC").alias("utc"))


@query("norm_dst", f"SELECT event_id, CASE WHEN local >= TIMESTAMP '2024-03-31 02:00:00' AND local < TIMESTAMP '2024-03-31 03:00:00' THEN NULL WHEN local >= TIMESTAMP '2024-10-27 02:00:00' AND local < TIMESTAMP '2024-10-27 03:00:00' THEN NULL WHEN local >= TIMESTAMP '2024-03-31 03:00:00' AND local < TIMESTAMP '2024-10-27 02:00:00' THEN local - INTERVAL 2 HOUR ELSE local - INTERVAL 1 HOUR END AS utc FROM (SELECT event_id, TIMESTAMP '2024-03-30 00:30:00' + INTERVAL (event_id % 5000) HOUR AS local FROM events)")
def norm_dst(spark, d):
    """Local times of 2024 in a zone with summer time: skipped and repeated ones are null."""
    start = F.lit("2024-03-30 00:30:00").cast("timestamp_ntz")
    local = start + F.make_dt_interval(hours=(F.col("event_id") % 5000).cast("int"))
    return table(spark, d, "events").select("event_id", normalize.timestamp_utc(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), "Europe/Berlin").alias("utc"))


@query("iso_texts", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'run-' || event_id END AS correlation_id, NOT (event_id % 4 = 0) AS finite FROM events")
def iso_texts(spark, d):
    """Instants as text, well-formed correlation ids, and finite numbers."""
    value = F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("event_id").cast("double"))
    text = F.concat(F.lit("run-"), "event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise(""))
    return table(spark, d, "events").select("event_id", normalize.utc_iso(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("iso"), normalize.correlation_id(text).alias("correlation_id"), finite(value).alias("finite"))


@query("price_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) END AS amount FROM orders")
def price_parse(spark, d):
    text = F.concat(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, " AMD").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", normalize.decimal_text(normalize.decimal_amount(text, 18, 2)).alias("amount"))


# --- record rules


@query("validate_availability", "SELECT l_orderkey, l_linenumber, l_quantity <= CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 30 END OR l_linenumber % 3 = 0 AS valid FROM lineitem")
def validate_availability(spark, d):
    total = F.when(F.col("l_linenumber") % 3 != 0, 30.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", availability_holds(F.col("l_quantity"), total).alias("valid"))


@query("validate_constraint", "SELECT o_orderkey, (o_orderkey % 2 = 0 OR o_orderdate <= TIMESTAMP '2024-06-01') AND o_totalprice <= 200000 AS valid FROM orders")
def validate_constraint(spark, d):
    end = F.when(F.col("o_orderkey") % 2 != 0, F.lit("2024-06-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", constraint_holds(F.col("o_orderdate").cast("timestamp_ntz"), end, F.col("o_totalprice"), F.lit(200000.0)).alias("valid"))


@query("validate_clearing", "SELECT o_orderkey, o_orderstatus = 'F' OR o_totalprice > 100000 AS valid FROM orders")
def validate_clearing(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("cleared")
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", clearing_holds(status, price).alias("valid"))


@query("validate_settlement", "SELECT o_orderkey, o_orderdate < TIMESTAMP '2024-06-01' AND o_orderkey % 4 <> 0 AS valid FROM orders")
def validate_settlement(spark, d):
    other = F.when(F.col("o_orderkey") % 4 == 0, "EUR").otherwise("AMD")
    amd = F.lit("AMD")
    return table(spark, d, "orders").select("o_orderkey", settlement_holds(F.col("o_orderdate").cast("timestamp_ntz"), F.lit("2024-06-01").cast("timestamp_ntz"), amd, amd, other, amd).alias("valid"))


# --- horizon reads: events stand in for situational records

_START, _END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def _horizon(name: str, entity: str | None, column: str, value: str | None) -> None:
    where = f" AND {column} = '{value}'" if entity else ""
    shown = f"{column} AS {entity}, " if entity else ""

    def run(spark, d):
        rows = table(spark, d, "events").withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))
        rows = rows.withColumnRenamed(column, entity) if entity else rows
        found = horizon.within(rows, _START, _END, **({entity: value} if entity else {}))
        return found.select("event_id", *([entity] if entity else []), "timestamp", "value")

    query(f"horizon_{name}", f"SELECT event_id, {shown}ts AS timestamp, value FROM events WHERE ts >= TIMESTAMP '{_START}' AND ts < TIMESTAMP '{_END}'{where}")(run)


for _row in (("weather", "location_id", "event_type", "view"), ("hydro", "resource_id", "event_type", "click"), ("availability", "asset_id", "event_type", "purchase"), ("news", None, "event_type", None)):
    _horizon(*_row)


@query("horizon_price", f"SELECT market_id, currency, timestamp, CAST(amount_per_mwh AS DOUBLE) AS amount_per_mwh FROM {PRICE_SQL} WHERE market_id = '1-URGENT' AND timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1997-01-01'")
def horizon_price(spark, d):
    return _rounded(horizon.within(price_daily(spark, d), "1996-01-01 00:00:00", "1997-01-01 00:00:00", market_id="1-URGENT"), "amount_per_mwh")


# --- persistence


@query("upsert_coalesce", f"SELECT consumer_id, timestamp, min(value_mw) AS value_mw, count(*) AS n, min(value_mw) <> max(value_mw) AS conflict FROM {RAW_SQL} GROUP BY ALL")
def upsert_coalesce(spark, d):
    return store.coalesce(load_raw(spark, d))


@query("upsert_classify", f"SELECT i.consumer_id, i.timestamp, CASE WHEN lo <> hi THEN 'conflict' WHEN s IS NULL THEN 'insert' WHEN s = lo THEN 'skip' ELSE 'conflict' END AS action FROM (SELECT consumer_id, timestamp, min(value_mw) AS lo, max(value_mw) AS hi FROM {RAW_SQL} GROUP BY ALL) i LEFT JOIN (SELECT consumer_id, timestamp, min(value_mw) + CASE WHEN min(pos) % 5 = 0 THEN 1 ELSE 0 END AS s FROM {RAW_SQL} WHERE pos % 2 = 0 GROUP BY ALL) USING (consumer_id, timestamp)")
def upsert_classify(spark, d):
    raw = load_raw(spark, d)
    changed = F.min("value_mw") + F.when(F.min("pos") % 5 == 0, 1).otherwise(0)
    stored = raw.filter("pos % 2 = 0").groupBy("consumer_id", "timestamp").agg(changed.alias("value_mw"))
    return store.upsert_actions(raw, stored)


@query("dlq_classify", "SELECT sha256('events:row:' || event_id) AS key, CASE WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 3 = 1 THEN 'skip' ELSE 'conflict' END AS action FROM events")
def dlq_classify(spark, d):
    letters = table(spark, d, "events").select(F.concat(F.lit("events:row:"), "event_id").alias("record_id"), F.lit("events").alias("source_name"), F.col("event_type").alias("code"), "event_id")
    stored = letters.filter("event_id % 3 <> 0").withColumn("code", F.when(F.col("event_id") % 3 == 2, "other").otherwise(F.col("code")))
    return store.dead_letter_actions(letters.drop("event_id"), stored.drop("event_id"))


# --- documents and vectors


@query("doc_chunks", r"""SELECT document_id, document_id || ':' || ordinal AS chunk_id, ordinal, text, page_number FROM
    (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS INTEGER) AS ordinal, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, CAST(page_number AS INTEGER) AS page_number FROM
    (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(1, len(p) + 1)) AS page_number, unnest(p) AS text FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS p FROM documents))
    WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')""")
def doc_chunks(spark, d):
    return documents.split_chunks(table(spark, d, "documents"))


def _entries(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.lit("embeddings").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id", "label")


@query("vector_entries", "SELECT 'embeddings' AS document_id, CAST(vec_id AS VARCHAR) AS chunk_id, len(embedding) AS dimension, label FROM embeddings")
def vector_entries(spark, d):
    entries = _entries(spark, d)
    joined = vectors.prepare(entries.select("document_id", "chunk_id", "label"), entries)
    return joined.select("document_id", "chunk_id", F.size("vector").cast("bigint").alias("dimension"), "label")


@query("vector_index_classify", "SELECT 'embeddings' AS document_id, CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'insert' WHEN vec_id % 3 = 1 THEN 'skip' ELSE 'conflict' END AS action FROM embeddings")
def vector_index_classify(spark, d):
    entries = _entries(spark, d)
    marked = vectors.fingerprinted(entries, "vector", "label")
    other = entries.withColumn("label", F.when(F.col("vec_id") % 3 == 2, F.col("label") + 1).otherwise(F.col("label")))
    return vectors.classify(marked, vectors.fingerprinted(other.filter("vec_id % 3 <> 0"), "vector", "label"))


@query("fingerprint", "SELECT 'embeddings' AS document_id, CAST(vec_id AS VARCHAR) AS chunk_id, true AS digest, vec_id % 3 <> 2 AS same FROM embeddings")
def fingerprint(spark, d):
    """Each entry's fingerprint is a digest, and equals that of a copy if and only if the contents are equal."""
    entries = _entries(spark, d)
    copy = entries.withColumn("label", F.when(F.col("vec_id") % 3 == 2, F.col("label") + 1).otherwise(F.col("label")))
    both = vectors.fingerprinted(entries, "vector", "label").join(vectors.fingerprinted(copy, "vector", "label").select("chunk_id", F.col("fingerprint").alias("other")), "chunk_id")
    return both.select("document_id", "chunk_id", F.col("fingerprint").rlike("^[0-9a-f]{64}$").alias("digest"), (F.col("fingerprint") == F.col("other")).alias("same"))


@query("fingerprint_digest", """SELECT CAST(vec_id AS VARCHAR) AS chunk_id, sha256('{"document_id":"embeddings","chunk_id":"' || vec_id || '","label":' || coalesce(CAST(label AS VARCHAR), 'null') || '}') AS fingerprint FROM embeddings""")
def fingerprint_digest(spark, d):
    """The digests themselves, over entries whose content both engines write alike."""
    return vectors.fingerprinted(_entries(spark, d), "label").select("chunk_id", "fingerprint")


_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@query("payload_decode", "SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN 'payload' WHEN vec_id % 7 = 2 THEN 'type' WHEN vec_id % 7 = 3 THEN 'digest' WHEN vec_id % 7 = 4 THEN 'id' END AS problem, CASE WHEN vec_id % 7 IN (0, 5, 6) THEN CAST(vec_id % 100 AS INTEGER) END AS ordinal, CASE WHEN vec_id % 7 IN (0, 5, 6) THEN 'chunk ' || vec_id END AS text FROM embeddings")
def payload_decode(spark, d):
    """Stored entries of which every seventh lacks a field, has a wrong type, a bad digest, or another entry's id."""
    case = F.col("vec_id") % 7
    ids = F.lit("embeddings"), F.col("vec_id").cast("string")
    text = F.concat(F.lit("chunk "), "vec_id")
    digest = F.when(case == 3, "none").otherwise(F.sha2(text, 256))
    fields = [ids[0].alias("document_id"), ids[1].alias("chunk_id"), text.alias("text"), F.lit(None).cast("int").alias("page_number"), digest.alias("content_sha256")]
    whole = F.to_json(F.struct(*fields, (F.col("vec_id") % 100).alias("ordinal")), {"ignoreNullFields": "false"})
    odd = F.to_json(F.struct(*fields, F.lit("1").alias("ordinal")), {"ignoreNullFields": "false"})
    payload = F.when(case == 1, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).when(case == 2, odd).otherwise(whole)
    place = normalize.point_uuid(_NAMESPACE, ids[0], F.when(case == 4, "other").otherwise(ids[1]))
    points = table(spark, d, "embeddings").select("vec_id", place.alias("id"), payload.alias("payload"))
    return vectors.decode_payloads(points, _NAMESPACE, keep=("vec_id",)).select("vec_id", "problem", "ordinal", "text")


@query("collection_check", "SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'absent' WHEN n_nationkey % 4 = 1 THEN 'ready' WHEN n_nationkey % 4 = 2 THEN 'other_dimension' ELSE 'other_distance' END AS status FROM nation")
def collection_check(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("case"), F.lit(64).alias("dimension"), F.lit("cosine").alias("distance"))
    existing = rows.filter(F.col("case") > 0).select("name", F.when(F.col("case") == 2, 32).otherwise(64).alias("dimension"), F.when(F.col("case") == 3, "dot").otherwise("cosine").alias("distance"))
    return vectors.collection_status(rows, existing)


@query("validate_dead_letter", "SELECT event_id, event_id % 5 <> 0 AS valid FROM events")
def validate_dead_letter(spark, d):
    notes = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return table(spark, d, "events").select("event_id", dead_letter_holds(notes).alias("valid"))


_DISTANCE_SQL = {
    "cosine": ("list_sum(list_transform(list_zip(v, q), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))", "DESC"),
    "dot": ("list_sum(list_transform(list_zip(v, q), lambda x: x[1] * x[2]))", "DESC"),
    "euclid": ("sqrt(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))", "ASC"),
    "manhattan": ("list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2])))", "ASC"),
}


def _knn(distance: str) -> None:
    value, order = _DISTANCE_SQL[distance]

    def run(spark, d):
        rows = table(spark, d, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
        asked = rows.orderBy("vec_id").select("vector").first().vector
        found = vectors.search(rows, asked, 10, distance, len(asked), ("vec_id",))
        return _rounded(found, "score").select("vec_id", "score", F.col("rank").cast("bigint").alias("rank"))

    query(f"knn_{distance}", f"SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score {order}, vec_id) AS rank FROM (SELECT vec_id, {value} AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM embeddings)) ORDER BY score {order}, vec_id LIMIT 10")(run)


def _knn_batch(distance: str) -> None:
    value, order = _DISTANCE_SQL[distance]

    def run(spark, d):
        rows = table(spark, d, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
        found = vectors.search_all(rows, rows.filter("vec_id % 20 = 0"), 10, distance)
        return _rounded(found, "score").select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))

    query(f"knn_batch_{distance}", f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM (SELECT query_id, vec_id, {value} AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) CROSS JOIN (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0))) WHERE rank <= 10")(run)


for _distance in vectors.DISTANCES:
    _knn(_distance)
    _knn_batch(_distance)

QUERIES |= source_queries.QUERIES
ORACLES |= source_queries.ORACLES
