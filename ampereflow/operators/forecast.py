"""Forecasts for requested instants from history: persistence and a given two-lag fit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..functions.normalize import timestamp_utc
from ..schemas import non_empty
from ..series import LOAD, Series
from .regression import AMOUNT, PREDICTED, TERM, exact


def _lagged(targets: DataFrame, history: DataFrame, series: Series, hours: int) -> DataFrame:
    """``targets`` with ``lag_<h>h`` and how many history rows stand at that instant."""
    name = f"lag_{hours}h"
    past = history.groupBy(*series.row).agg(F.max(series.value).alias(name), F.count(F.lit(1)).alias(f"n_{hours}h"))
    past = past.withColumn(series.time, F.col(series.time) + F.expr(f"INTERVAL '{hours}' HOUR"))
    return targets.join(past, list(series.row), "left")


def persistence(targets: DataFrame, history: DataFrame, series: Series) -> DataFrame:
    """Every target with ``predicted``, its entity's value a day before, and ``status``.

    ``status`` is ``ok``, ``missing`` or ``duplicate`` (``predicted`` is then null). Repeated targets
    stay. History is aggregated by instant before it is joined, so repeats never multiply targets.
    """
    rows = _lagged(targets, history, series, 24)
    status = F.when(F.col("n_24h").isNull(), "missing").when(F.col("n_24h") > 1, "duplicate").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.select(*targets.columns, F.when(F.col("status") == "ok", F.col("lag_24h")).alias("predicted"), "status")


def ols(targets: DataFrame, history: DataFrame, fit: DataFrame, series: Series) -> DataFrame:
    """Every target with a two-lag prediction and ``status``.

    The day before is checked before the week before. A load may not be negative (``negative``); a
    price may. ``fit`` has a row for each entity; an entity without a sound fit is ``unfitted``.
    """
    rows = _lagged(_lagged(targets, history, series, 24), history, series, 168)
    sound = exact(fit, series).filter("status = 'ok'").drop("n", "status")
    rows = rows.join(sound, list(series.keys), "left")
    if series == LOAD:
        value = F.col("intercept") + F.col("b1") * F.col("lag_24h").cast("double") + F.col("b2") * F.col("lag_168h").cast("double")
    else:
        times = lambda c, name: F.try_multiply(F.col(c), F.col(name).try_cast(AMOUNT)).try_cast(TERM)
        value = F.try_add(F.try_add(times("b1", "lag_24h"), times("b2", "lag_168h")).try_cast(TERM), F.col("intercept")).try_cast(PREDICTED)
    status = F.lit(None).cast("string")
    for hours in (24, 168):
        status = F.coalesce(status, F.when(F.col(f"n_{hours}h").isNull(), f"missing_{hours}h").when(F.col(f"n_{hours}h") > 1, f"duplicate_{hours}h"))
    status = F.coalesce(status, F.when(F.col("b1").isNull() | F.col("b2").isNull() | F.col("intercept").isNull(), "unfitted"))
    if series == LOAD:
        status = F.coalesce(status, F.when(value < 0, "negative"))
    rows = rows.withColumn("status", F.coalesce(status, F.lit("ok")))
    return rows.select(*targets.columns, F.when(F.col("status") == "ok", value).alias("predicted"), "status")


def require_forecast(forecast: DataFrame) -> DataFrame:
    """``forecast`` if every target is ok, else an error: one bad target fails the request."""
    bad = forecast.filter("status <> 'ok'").select("status").limit(1).collect()
    if bad:
        raise InvalidRequestError(f"a target can't be forecast: {bad[0].status}")
    return forecast


def check_request(history: DataFrame, targets: DataFrame, series: Series, entity: dict[str, str], run_id: str, generated_at: datetime) -> None:
    """A request has a run id, a generation time in UTC, one entity and a target at least; its history is of that entity alone."""
    if not run_id or not run_id.strip() or any(not entity[k] or not entity[k].strip() for k in series.keys):
        raise InvalidRequestError("an id is empty")
    if generated_at.utcoffset() is None or generated_at.utcoffset():
        raise InvalidRequestError("the generation time is not in UTC")
    if not targets.limit(1).count():
        raise InvalidRequestError("no target was requested")
    other = F.lit(False)
    for key in series.keys:
        other = other | ~F.col(key).eqNullSafe(F.lit(entity[key]))
    if history.filter(other).limit(1).count():
        raise InvalidRequestError("the history belongs to another entity")


#: A stamp that ends in UTC.
_IN_UTC = r"(Z|[+-]00(:?00)?)\s*$"


def judge_requests(requests: DataFrame, history: DataFrame, series: Series) -> DataFrame:
    """``(request_id, verdict)`` of many requests at once, by the rules of :func:`check_request`; ``verdict`` is null where all hold.

    ``requests``: ``request_id``, ``run_id``, the entity's keys, ``generated_at`` (text) and ``targets`` (a list). ``history``: ``request_id``
    and the entity's keys of each row. The first rule that is broken counts: ``empty_id``, ``not_utc`` (no instant with an offset of zero),
    ``no_target``, ``other_history``. History is cut to different entities of a request before it meets the request, so its
    length doesn't matter; a request without history is fine.
    """
    keys = list(series.keys)
    held = history.select("request_id", *[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    other = F.lit(False)
    for key in keys:
        other = other | ~F.col(key).eqNullSafe(F.col(f"__{key}"))
    strange = held.join(requests.select("request_id", *keys), "request_id").filter(other).select(F.col("request_id").alias("__strange")).distinct()
    empty = F.lit(False)
    for name in ("run_id", *keys):
        empty = empty | ~non_empty(F.col(name))
    aware = timestamp_utc(F.col("generated_at")).isNotNull() & F.col("generated_at").rlike(_IN_UTC)
    rules = [("empty_id", empty), ("not_utc", ~F.coalesce(aware, F.lit(False))), ("no_target", F.coalesce(F.size("targets"), F.lit(0)) < 1), ("other_history", F.col("__strange").isNotNull())]
    broken = F.array(*[F.when(holds, F.struct(F.lit(n).alias("rule"), F.lit(name).alias("name"))) for n, (name, holds) in enumerate(rules)])
    joined = requests.join(strange, F.col("request_id") == F.col("__strange"), "left")
    return joined.select("request_id", F.array_min(broken)["name"].alias("verdict"))
