"""Local times of a zone as UTC by built-in functions: a table of the zone's periods, met by year and then by bounds.

A period has one offset and holds a stretch of local times. Where the clock goes forward, local times lie in no
period, where it goes back, in two; only those that lie in one are told. Zones repeat their rules every 400 years, as
the calendar does, so a table of the years up to :data:`LAST` stands for all.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import broadcast_within

#: Years of the table; times before the first have the first period's offset.
FIRST, LAST = 1800, 2499
#: The calendar repeats, and with it the rules that a zone has at the table's end.
_CYCLE_YEARS, _CYCLE_US = 400, 146_097 * 86_400_000_000
_DAY = 86_400
_PERIODS = "array<struct<lo:bigint,hi:bigint,offset:bigint>>"


def _second(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


@lru_cache(maxsize=64)
def periods(name: str) -> tuple[tuple[int | None, int | None, int], ...]:
    """``(first, end, offset)`` of the zone's periods between :data:`FIRST` and :data:`LAST`, in UTC seconds; open at both ends.

    Offsets are asked day by day, and a change is found to the second by halving.
    """
    place = ZoneInfo(name)

    def offset(second: int) -> int:
        return int(datetime.fromtimestamp(second, place).utcoffset().total_seconds())

    out, begun, current = [], None, offset(_second(FIRST))
    for second in range(_second(FIRST), _second(LAST + 1), _DAY):
        here = offset(second)
        if here != current:
            low, high = second - _DAY, second
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == current else (low, middle)
            out.append((begun, high, current))
            begun, current = high, offset(high)
            if current != here:  # a second change on the same day
                low, high = high, second
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(middle) == current else (low, middle)
                out.append((begun, high, current))
                begun, current = high, here
    return (*out, (begun, None, current))


@lru_cache(maxsize=64)
def by_year(name: str) -> str:
    """JSON list of the years from :data:`FIRST` to :data:`LAST`, each the list of periods that hold local times of it, in microseconds."""
    edge = 1 << 62
    local = [(-edge if a is None else (a + o) * 10**6, edge if b is None else (b + o) * 10**6, o * 10**6) for a, b, o in periods(name)]
    years, i = [], 0
    for year in range(FIRST, LAST + 1):
        begin, end = _second(year) * 10**6, _second(year + 1) * 10**6
        while i < len(local) and local[i][1] <= begin and (i + 1 < len(local) and local[i + 1][0] <= begin):
            i += 1
        held = []
        for k in range(max(0, i - 2), len(local)):
            lo, hi, o = local[k]
            if lo >= end + 2 * _DAY * 10**6:
                break
            if lo < end and hi > begin:
                held.append({"lo": lo, "hi": hi, "offset": o})
        years.append(held)
    return json.dumps(years)


def _cycles(local: Column) -> Column:
    """How many times 400 years a local time lies behind the table."""
    return F.greatest(F.lit(0), F.ceil((F.year(local) - LAST) / F.lit(_CYCLE_YEARS)))


def _utc(local: Column, held: Column) -> Column:
    shift = _cycles(local).cast("bigint") * F.lit(_CYCLE_US)
    micros = F.unix_micros(local.cast("timestamp")) - shift
    found = F.filter(held, lambda p: (p["lo"] <= micros) & (micros < p["hi"]))
    return F.when(F.size(found) == 1, F.timestamp_micros(micros + shift - F.get(found, F.lit(0))["offset"]).cast("timestamp_ntz"))


def _year(local: Column) -> Column:
    """The year of the table whose periods hold a local time."""
    return F.greatest(F.lit(FIRST), F.year(local) - (_cycles(local) * _CYCLE_YEARS)).cast("int")


def local_to_utc(local: Column, name: str) -> Column:
    """UTC of zone-less times of a zone; null where the local time is skipped or happens twice. The session's zone must be UTC."""
    table = F.from_json(F.lit(by_year(name)), f"array<{_PERIODS}>")
    return _utc(local, F.get(table, _year(local) - FIRST))


def zone_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(zone, year, periods)`` of the named zones, a few hundred rows each."""
    rows = spark.createDataFrame([(n, by_year(n)) for n in names], "zone string, years string")
    return rows.select("zone", F.posexplode(F.from_json("years", f"array<{_PERIODS}>")).alias("at", "periods")).select("zone", (F.col("at") + FIRST).alias("year"), "periods")


def localize(rows: DataFrame, zones: DataFrame, local: str = "local", zone: str = "zone", broadcast_rows: int = 200_000) -> DataFrame:
    """``rows`` with ``utc``, each row's local time in its own zone, by a join with :func:`zone_table` on zone and year.

    Null for null and unknown zones and for local times that are skipped or happen twice.
    """
    table = zones.select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("periods").alias("__periods"))
    met = rows.join(broadcast_within(table, broadcast_rows), (F.col(zone) == F.col("__zone")) & (_year(F.col(local)) == F.col("__year")), "left")
    return met.withColumn("utc", _utc(F.col(local), F.col("__periods"))).drop("__zone", "__year", "__periods")
