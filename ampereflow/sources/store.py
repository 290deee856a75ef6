"""Idempotent, conflict-checked writes: observations, dead letters, and a small cache."""

from __future__ import annotations

import hashlib
import math
import time
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, DependencyUnavailableError, InvalidRequestError
from ..operators.vectors import BROADCAST_KEYS, classify, require_stored
from ..schemas import non_empty, non_negative
from ..series import LOAD, Series
from ..shared import batches, broadcast_within, materialize, publish

#: Hex digits of a dead letter's key that name its folder.
PREFIX = 2


def create_observations(spark: SparkSession, table: str) -> None:
    """The table of observations, by day; its rules are checked before each write."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (consumer_id STRING, timestamp TIMESTAMP_NTZ, value_mw DOUBLE, day DATE) USING parquet PARTITIONED BY (day)")


def coalesce(rows: DataFrame, series: Series = LOAD) -> DataFrame:
    """Each entity and instant once, with ``value`` and ``conflict`` for repeats that differ."""
    grouped = rows.groupBy(*series.row).agg(F.min(series.value).alias(series.value), F.max(series.value).alias("__high"), F.count(F.lit(1)).alias("n"))
    return grouped.select(*series.row, series.value, "n", (~F.col(series.value).eqNullSafe(F.col("__high"))).alias("conflict"))


def upsert_actions(incoming: DataFrame, stored: DataFrame, series: Series = LOAD) -> DataFrame:
    """For each entity and instant: ``insert``, ``skip`` (equal) or ``conflict``."""
    return classify(incoming, stored, series.row, series.value)


def _days_of(stored: DataFrame, rows: DataFrame, time: str) -> DataFrame:
    """The stored rows of the days that ``rows`` span, by the partition column, so that other days are not read."""
    ends = rows.agg(F.min(F.to_date(time)).alias("low"), F.max(F.to_date(time)).alias("high")).first()
    return stored.filter(F.col("day").between(F.lit(ends.low), F.lit(ends.high))) if "day" in stored.columns else stored


def save(rows: DataFrame, path: str, series: Series = LOAD) -> int:
    """Add what is new to the table of batches at ``path``; the number of rows written.

    Invalid rows and conflicts, within the batch or with the table, are raised before anything is
    written, and equal rows are skipped, so a retry changes nothing. The new rows are one batch: they are staged, read
    back and compared, and only then moved into place together (:func:`shared.publish`). A missing row means that the store
    failed, a different one a conflict, and either leaves the table as it was. Two writers at once are not
    isolated from each other by plain Parquet.
    """
    spark = rows.sparkSession
    good = non_empty(F.col(series.keys[0])) & F.col(series.time).isNotNull()
    good = good & (non_negative(F.col(series.value)) if series == LOAD else F.col(series.value).isNotNull())
    if rows.filter(~good).limit(1).count():
        raise InvalidRequestError("a row breaks the table's rules")
    dated = T.StructType([*rows.schema.fields, T.StructField("day", T.DateType())])
    stored = _days_of(batches(spark, path, dated), rows, series.time).drop("day")
    actions = materialize(upsert_actions(rows, stored, series), "actions")
    if actions.filter("action = 'conflict'").limit(1).count():
        raise ConflictError("a row differs from the stored one")
    wanted = actions.filter("action = 'insert'").select(*series.row)
    count = wanted.count()
    if count:
        fresh = materialize(rows.join(broadcast_within(wanted, BROADCAST_KEYS), list(series.row), "left_semi").dropDuplicates(list(series.row)), "fresh")
        publish(fresh.withColumn("day", F.to_date(series.time)), path, lambda staged: require_stored(fresh, staged, series.row, series.value), by="day")
    return count


def letter_key(record_id):
    return F.sha2(record_id, 256)


def dead_letter_actions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``key, action`` for each dead letter, by its id's hash and the equality of its whole content."""
    content = F.sha2(F.to_json(F.struct(*sorted(incoming.columns)), {"ignoreNullFields": "false"}), 256)
    mark = lambda rows: rows.select(letter_key(F.col("record_id")).alias("key"), content.alias("content"))
    return classify(mark(incoming), mark(stored.select(*incoming.columns)), ("key",), "content")


def letters_of(spark: SparkSession, path: str, schema: T.StructType, prefixes: list[str] | None = None) -> DataFrame:
    """The stored dead letters at ``path``; with ``prefixes``, those of these key prefixes alone, from no other folder."""
    stored = batches(spark, path, T.StructType([*schema.fields, T.StructField("prefix", T.StringType())]), "json")
    return (stored if prefixes is None else stored.filter(F.col("prefix").isin(*prefixes))).select(*schema.names)


def enqueue(letters: DataFrame, path: str) -> int:
    """Add dead letters as one batch of JSON; an equal retry is a no-op, another content for an id is a conflict.

    Letters lie in folders by the first two digits of their key. A call reads those of its own letters, of which there are
    at most 256; what it writes is staged, read back and compared before it is moved into place. A failure leaves the store as it was.
    """
    spark = letters.sparkSession
    keyed = letters.withColumn("__key", letter_key(F.col("record_id"))).withColumn("prefix", F.substring("__key", 1, PREFIX))
    prefixes = sorted(r.prefix for r in keyed.select("prefix").distinct().collect())  # at most 16 ** PREFIX
    stored = letters_of(spark, path, letters.schema, prefixes) if prefixes else letters.limit(0)
    actions = materialize(dead_letter_actions(letters, stored), "actions")
    if actions.filter("action = 'conflict'").limit(1).count():
        raise ConflictError("a dead letter differs from the stored one")
    wanted = actions.filter("action = 'insert'").select(F.col("key").alias("__key"))
    count = wanted.count()
    if count:
        fresh = materialize(keyed.join(broadcast_within(wanted, BROADCAST_KEYS), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key"), "letters")

        def check(staged: DataFrame) -> None:
            actions = {r.action for r in dead_letter_actions(fresh.drop("prefix"), staged.drop("prefix")).select("action").distinct().collect()}  # at most three
            if actions - {"skip"}:
                raise DependencyUnavailableError("a written dead letter can't be read back")

        publish(fresh, path, check, by="prefix", kind="json")
    return count


class TtlCache:
    """Small values on the driver for a limited time; keys are kept as hashes."""

    def __init__(self, encode: Callable[[Any], bytes], decode: Callable[[bytes], Any], prefix: str = "cache:", clock: Callable[[], float] = time.monotonic):
        self._encode, self._decode, self._prefix, self._clock = encode, decode, prefix, clock
        self._rows: dict[str, tuple[float, bytes]] = {}

    def _key(self, key: str) -> str:
        if not key.strip():
            raise InvalidRequestError("the key is empty")
        return self._prefix + hashlib.sha256(key.strip().encode()).hexdigest()

    def set(self, key: str, value: Any, seconds: float) -> None:
        """Times to live are rounded up to whole milliseconds."""
        if not seconds > 0:
            raise InvalidRequestError("the time to live must be positive")
        place = self._key(key)
        try:
            data = self._encode(value)
        except Exception as error:
            raise DependencyUnavailableError("the value can't be encoded") from error
        self._rows[place] = (self._clock() + math.ceil(seconds * 1000) / 1000, data)

    def get(self, key: str) -> Any | None:
        place = self._key(key)
        until, data = self._rows.get(place, (0.0, b""))
        if place not in self._rows or self._clock() >= until:
            self._rows.pop(place, None)
            return None
        try:
            return self._decode(data)
        except Exception as error:
            raise DependencyUnavailableError("the value can't be decoded") from error

    def delete(self, key: str) -> None:
        self._rows.pop(self._key(key), None)
