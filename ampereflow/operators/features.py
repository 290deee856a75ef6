"""Exact-lag features, chronological splits and persistence cases."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import Series

HOUR = 3_600_000_000


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def lag_features(history: DataFrame, series: Series, hours: tuple[int, ...] = (24,)) -> DataFrame:
    """Rows whose exact lags all exist: keys, time, ``lag_<h>h`` for each lag, ``target``.

    A lag is elapsed time; nothing is interpolated and no neighbour stands in for a missing instant.
    Instants that are a lag apart agree in their remainder by the lags' common divisor, so one shuffle
    by entity and remainder serves all lags, and a range frame that is a single instant reads each.
    With unique instants a group has at most one row for each divisor's length of history, however many
    rows its entity has. Time zones must be UTC. An empty history gives no rows.
    """
    at = micros(F.col(series.time))
    step = reduce(gcd, hours) * HOUR
    group = Window.partitionBy(*series.keys, "__phase").orderBy("__at")
    lags = [F.first(series.value).over(group.rangeBetween(-h * HOUR, -h * HOUR)).alias(f"lag_{h}h") for h in hours]
    marked = history.select(*series.row, series.value, at.alias("__at"), F.pmod(at, F.lit(step)).alias("__phase"))
    found = marked.select(*series.row, *lags, F.col(series.value).alias("target"))
    return found.dropna(subset=[f"lag_{h}h" for h in hours])


def split(rows: DataFrame, series: Series, cutoff: str) -> DataFrame:
    """``rows`` with ``part``: ``train`` before the cutoff, ``evaluation`` from it on."""
    early = F.col(series.time) < F.lit(cutoff).cast("timestamp_ntz")
    return rows.withColumn("part", F.when(early, "train").otherwise("evaluation"))


def persistence_cases(history: DataFrame, series: Series) -> DataFrame:
    """Keys, time, ``predicted`` (the value a day before) and ``actual``, where the day before is known."""
    rows = lag_features(history, series, (24,))
    return rows.select(*series.row, F.col("lag_24h").alias("predicted"), F.col("target").alias("actual"))
