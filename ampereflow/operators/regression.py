"""Least squares on lag features, predictions, mean absolute errors, and comparisons of models."""

from __future__ import annotations

from decimal import Context, Decimal, DivisionByZero, InvalidOperation
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import LOAD, Series

#: Prices, slopes and intercepts, their products, and predictions and errors, as decimals.
AMOUNT, SLOPE, INTERCEPT, TERM, PREDICTED = "decimal(18,4)", "decimal(26,18)", "decimal(32,15)", "decimal(34,15)", "decimal(30,12)"


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def fit_one(training: DataFrame, series: Series) -> DataFrame:
    """Per entity: ``n, slope, intercept, status`` of target on ``lag_24h``.

    ``status`` is ``ok``, ``insufficient`` (fewer than two rows) or ``singular`` (the feature does not
    vary); coefficients are null unless ``ok``. Moments are aggregated before the shuffle, so a hot
    entity is no hot task.
    """
    x, y = _double("lag_24h"), _double("target")
    sums = training.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    status = F.when(F.col("n") < 2, "insufficient").when(F.col("xx") == 0, "singular").otherwise("ok")
    slope = F.when(F.col("status") == "ok", F.try_divide("xy", "xx"))
    fitted = sums.withColumn("status", status).withColumn("slope", slope)
    return fitted.select(*series.keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "status")


def fit_two(training: DataFrame, series: Series, tolerance: float = 0.0) -> DataFrame:
    """Per entity: ``n, b1, b2, intercept, status`` of target on ``lag_24h`` and ``lag_168h``.

    Closed form of the centred normal equations. ``singular`` where the determinant is at most
    ``tolerance`` times the product of the features' variances (zero or less by default).
    """
    a, b, y = _double("lag_24h"), _double("lag_168h"), _double("target")
    sums = training.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[f.alias(k) for k, f in {"aa": F.var_pop(a), "bb": F.var_pop(b), "ab": F.covar_pop(a, b), "ay": F.covar_pop(a, y), "by": F.covar_pop(b, y), "ma": F.avg(a), "mb": F.avg(b), "my": F.avg(y)}.items()],
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    status = F.when(F.col("n") < 3, "insufficient").when(F.col("det") <= tolerance * F.col("aa") * F.col("bb"), "singular").otherwise("ok")
    fitted = sums.withColumn("det", det).withColumn("status", status)
    good = F.when(F.col("status") == "ok", F.col("det"))
    b1 = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), good)
    b2 = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), good)
    fitted = fitted.withColumn("b1", b1).withColumn("b2", b2)
    return fitted.select(*series.keys, "n", "b1", "b2", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("intercept"), "status")


def _solve(x: list[Decimal], context: Context) -> tuple[Decimal | None, ...]:
    """Coefficients from n and the raw moments of one or two features, in decimals."""
    if len(x) == 5:
        n, sx, sy, sxx, sxy = x
        slope = context.divide(n * sxy - sx * sy, n * sxx - sx * sx)
        return slope, context.divide(sy - slope * sx, n)
    n, sa, sb, sy, saa, sbb, sab, say, sby = x
    aa, bb, ab, ay, by = n * saa - sa * sa, n * sbb - sb * sb, n * sab - sa * sb, n * say - sa * sy, n * sby - sb * sy
    det = aa * bb - ab * ab
    b1, b2 = context.divide(ay * bb - by * ab, det), context.divide(by * aa - ay * ab, det)
    return b1, b2, context.divide(sy - b1 * sa - b2 * sb, n)


def fit_decimal(training: DataFrame, series: Series, features: tuple[str, ...] = ("lag_24h",)) -> DataFrame:
    """Coefficients as exact decimal text: ``slope, intercept`` or ``b1, b2, intercept``, and ``status``.

    Spark sums the raw moments as decimals, which loses nothing while a value has at most 18 digits;
    one row per entity is then solved with 28 significant digits.
    """
    names = ["slope", "intercept"] if len(features) == 1 else ["b1", "b2", "intercept"]
    values = {f"s{i}": F.col(c) for i, c in enumerate((*features, "target"))}
    pairs = [(i, i) for i in range(len(features))] + ([(0, 1)] if len(features) == 2 else []) + [(i, len(features)) for i in range(len(features))]
    columns = [F.sum(c) for c in values.values()] + [F.sum(values[f"s{i}"] * values[f"s{j}"]) for i, j in pairs]
    sums = training.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[c.cast("string") for c in columns]).alias("moments"))
    least = len(features) + 1

    def solve(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = Context(prec=28)
        for table in tables:
            rows = []
            for n, moments in zip(table["n"], table["moments"]):
                try:
                    if n < least:
                        raise IndexError
                    rows.append([*map(str, _solve([Decimal(int(n)), *map(Decimal, moments)], context)), "ok"])
                except (InvalidOperation, DivisionByZero):
                    rows.append([*[None] * len(names), "singular"])
                except IndexError:
                    rows.append([*[None] * len(names), "insufficient"])
            yield pd.concat([table[list(series.keys) + ["n"]].reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "status"])], axis=1)

    keys = ", ".join(f"{k} string" for k in series.keys)
    return sums.mapInPandas(solve, f"{keys}, n bigint, {', '.join(f'{c} string' for c in names)}, status string")


def fit(training: DataFrame, series: Series, lags: int = 1) -> DataFrame:
    """The fit of each entity on one lag or two: in doubles for loads, in decimals for prices."""
    if series == LOAD:
        return fit_one(training, series) if lags == 1 else fit_two(training, series)
    return fit_decimal(training, series, ("lag_24h", "lag_168h")[:lags])


def exact(found: DataFrame, series: Series) -> DataFrame:
    """Coefficients as decimals of fixed scale; null where one is too large, which then predicts nothing."""
    if series == LOAD:
        return found
    return found.withColumns({c: F.col(c).try_cast(INTERCEPT if c == "intercept" else SLOPE) for c in ("slope", "b1", "b2", "intercept") if c in found.columns})


def predict(fit: DataFrame, rows: DataFrame, series: Series) -> DataFrame:
    """Keys, time, ``predicted, actual`` of rows whose entity has a sound fit; predictions may be negative.

    Loads are computed in doubles. Prices stay decimals: each product keeps 15 digits behind the point,
    and a prediction has 12.
    """
    two = "b1" in fit.columns
    sound = exact(fit, series).filter("status = 'ok'").drop("n", "status")
    lag = _double if series == LOAD else (lambda name: F.col(name).try_cast(AMOUNT))
    if series == LOAD:
        value = F.col("intercept") + F.col("b1") * lag("lag_24h") + F.col("b2") * lag("lag_168h") if two else F.col("slope") * lag("lag_24h") + F.col("intercept")
    else:
        times = lambda c, name: F.try_multiply(F.col(c), lag(name)).try_cast(TERM)
        value = F.try_add(F.try_add(times("b1", "lag_24h"), times("b2", "lag_168h")).try_cast(TERM), F.col("intercept")) if two else F.try_add(times("slope", "lag_24h"), F.col("intercept"))
        value = value.try_cast(PREDICTED)
    return rows.join(sound, list(series.keys)).select(*series.row, value.alias("predicted"), F.col("target").alias("actual"))


def _error(series: Series) -> Column:
    error = F.abs(F.col("predicted") - F.col("actual"))
    return error.cast("double") if series == LOAD else error.cast(PREDICTED)


def mean_absolute_error(cases: DataFrame, series: Series) -> DataFrame:
    """Per entity: ``n`` and ``mae``; errors of prices are summed as decimals, and their mean is one of 12 digits behind the point."""
    n = F.count(F.lit(1))
    mean = F.sum(_error(series)) / n if series == LOAD else F.try_divide(F.sum(_error(series)), n.cast("decimal(20,0)")).cast(PREDICTED)
    return cases.groupBy(*series.keys).agg(n.alias("n"), mean.alias("mae"))


def compare(cohorts: dict[str, DataFrame], series: Series) -> DataFrame:
    """Per entity: ``n``, ``mae_<model>`` for each cohort, and ``misaligned``; no winner is named.

    Cohorts must have the same instants with the same actual values. They are laid under one another
    and grouped by entity and instant, in one shuffle for any number of models; an instant that a
    cohort lacks or repeats, or whose actual values differ, counts as misaligned.
    """
    rows = None
    for name, cases in cohorts.items():
        actual = _double("actual") if series == LOAD else F.col("actual").cast(PREDICTED)
        part = cases.select(*series.row, F.lit(name).alias("model"), _error(series).alias("error"), actual.alias("actual"))
        rows = part if rows is None else rows.unionByName(part)
    by_model = {name: F.max(F.when(F.col("model") == name, F.col("error"))).alias(f"e_{name}") for name in cohorts}
    present = [F.count(F.when(F.col("model") == name, 1)) == 1 for name in cohorts]
    aligned = F.min("actual").eqNullSafe(F.max("actual"))
    for one in present:
        aligned = aligned & one
    instants = rows.groupBy(*series.row).agg(*by_model.values(), aligned.alias("aligned"))
    mean = (lambda c: F.avg(c)) if series == LOAD else (lambda c: F.try_divide(F.sum(c), F.count(c).cast("decimal(20,0)")).cast(PREDICTED))
    return instants.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("n"), *[mean(f"e_{name}").alias(f"mae_{name}") for name in cohorts], F.count(F.when(~F.col("aligned"), 1)).alias("misaligned"))


def backtest(features: DataFrame, series: Series, models: tuple[str, ...]) -> DataFrame:
    """Fit on the training part, predict the evaluation part and compare ``models``.

    ``features`` comes from ``split``; models are ``persistence``, ``ols1`` and ``ols2``. All of them
    see the same rows, which is what a comparison needs.
    """
    train, rows = features.filter("part = 'train'"), features.filter("part = 'evaluation'")
    cohorts = {}
    for model in models:
        if model == "persistence":
            cohorts[model] = rows.select(*series.row, F.col("lag_24h").alias("predicted"), F.col("target").alias("actual"))
        else:
            cohorts[model] = predict(fit(train, series, 1 if model == "ols1" else 2), rows, series)
    return compare(cohorts, series)
