"""Fail-closed forms of the operators for one entity: checks in a fixed order, then the set operator.

Inputs carry ``pos``, their order. Every check is an aggregate over the rows; texts are constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..operators import features, regression
from ..operators.validation import require_chronology, require_one_entity, require_unique
from ..series import LOAD, Series


def _empty(rows: DataFrame) -> bool:
    return not rows.limit(1).count()


def _finite(rows: DataFrame, *names: str) -> bool:
    bad = F.lit(False)
    for name in names:
        x = F.col(name).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return not rows.filter(bad).limit(1).count()


def lag_rows(history: DataFrame, series: Series, hours: tuple[int, ...] = (24,)) -> DataFrame:
    """Empty history gives no rows; else one entity and unique instants are required."""
    if not _empty(history):
        require_one_entity(history, series)
        require_unique(history, series)
    return features.lag_features(history, series, hours)


def split(rows: DataFrame, series: Series, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows; neither may be empty."""
    if _empty(rows):
        raise InvalidRequestError("there are no rows to split")
    require_one_entity(rows, series)
    require_chronology(rows, series)
    marked = features.split(rows, series, cutoff)
    train, evaluation = (marked.filter(F.col("part") == p).drop("part") for p in ("train", "evaluation"))
    if _empty(train):
        raise InvalidRequestError("no row is before the cutoff")
    if _empty(evaluation):
        raise InvalidRequestError("no row is at or after the cutoff")
    return train, evaluation


def fit(training: DataFrame, series: Series, lags: int = 1) -> DataFrame:
    """The sound fit of one entity."""
    least = lags + 1
    if training.limit(least).count() < least:
        raise InvalidRequestError("there are too few training rows")
    require_one_entity(training, series)
    require_chronology(training, series)
    inputs = ("lag_24h", "lag_168h")[:lags] + ("target",)
    if series != LOAD and not _finite(training, *inputs):
        raise InvalidRequestError("a training value is not finite")
    found = regression.fit(training, series, lags)  # prices in decimals
    row = found.first()
    if row.status == "singular":
        raise InvalidRequestError("the training features are singular")
    if not _finite(found, *[c for c in found.columns if c in ("slope", "b1", "b2", "intercept")]):
        raise InvalidRequestError("a coefficient is not finite")
    return found


def predict(fitted: DataFrame, rows: DataFrame, series: Series) -> DataFrame:
    """Predictions for every row; a load's fit is checked before its rows, a price's after."""
    if _empty(rows):
        raise InvalidRequestError("there are no rows to predict")

    def fit_is_finite() -> None:
        if not _finite(fitted, *[c for c in fitted.columns if c in ("slope", "b1", "b2", "intercept")]):
            raise InvalidRequestError("the fit is not finite")

    if series == LOAD:
        fit_is_finite()
    require_one_entity(rows, series)
    require_chronology(rows, series)
    if series != LOAD:
        fit_is_finite()
        if not _finite(rows, "lag_24h", *(["lag_168h"] if "b1" in fitted.columns else [])):
            raise InvalidRequestError("an input is not finite")
    found = regression.predict(fitted, rows, series)
    if not _finite(found, "predicted"):
        raise InvalidRequestError("a prediction is not finite")
    return found


def mean_absolute_error(cases: DataFrame, series: Series, persistence: bool = False) -> DataFrame:
    """Persistence of loads checks only that there are cases; all others check entity and order too."""
    if _empty(cases):
        raise InvalidRequestError("there are no cases")
    if not (persistence and series == LOAD):
        require_one_entity(cases, series)
        if "pos" in cases.columns:
            require_chronology(cases, series)
        if not _finite(cases, "predicted", "actual"):
            raise InvalidRequestError("a value is not finite")
    return regression.mean_absolute_error(cases, series)


def compare(cohorts: dict[str, DataFrame], series: Series) -> DataFrame:
    """Errors of all cohorts: not empty, equally long, of one entity, and aligned in instant and actual value."""
    sizes = []
    for cases in cohorts.values():
        if _empty(cases):
            raise InvalidRequestError("a cohort is empty")
        sizes.append(cases.count())
    if len(set(sizes)) != 1:
        raise InvalidRequestError("cohorts differ in length")
    keys = None
    for cases in cohorts.values():
        own = cases.select(*series.keys)
        keys = own if keys is None else keys.union(own)
    require_one_entity(keys, series)
    found = regression.compare(cohorts, series)
    if found.filter("misaligned > 0").limit(1).count():
        raise InvalidRequestError("cohorts are not aligned")
    return found.drop("misaligned")
