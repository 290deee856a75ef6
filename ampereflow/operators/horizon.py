"""Reads of situational records within a horizon."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequestError


def within(rows: DataFrame, start: str, end: str, time: str = "timestamp", **entity: str) -> DataFrame:
    """Rows of the entity from ``start`` on and before ``end`` (ISO texts in UTC).

    Plain comparisons with constants, which Parquet readers push down; no row is a valid result.
    """
    if datetime.fromisoformat(end) <= datetime.fromisoformat(start):
        raise InvalidRequestError("the horizon must end after it starts")
    kind = dict(rows.dtypes)[time]
    found = rows.filter((F.col(time) >= F.lit(start).cast(kind)) & (F.col(time) < F.lit(end).cast(kind)))
    for key, value in entity.items():
        found = found.filter(F.col(key) == value)
    return found
