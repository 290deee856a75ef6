"""Text to numbers and instants, without the leniency of a plain cast."""

from __future__ import annotations

import uuid
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..schemas import non_negative, stripped
from .zones import local_to_utc

#: Digits with an optional sign, point and exponent; no type suffixes, underscores or names of infinities.
NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: Date and time in extended or compact form with optional fraction and zone; a date or a number alone is none.
STAMP = r"\A([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})[T ]([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?)?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?\z"


def bound(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def number(text: Column) -> Column:
    """DOUBLE of a plain number; null for anything else."""
    return bound(stripped(text), lambda clean: F.when(clean.rlike(NUMBER), clean.try_cast("double")))


def power_mw(text: Column, unit: str) -> Column:
    """Megawatts from text in ``MW`` or ``kW``; kilowatts are divided as decimals. Null unless finite and not negative."""
    if unit not in ("MW", "kW"):
        raise InvalidRequestError("unsupported power unit")

    def convert(clean: Column) -> Column:
        value = clean.try_cast("double")
        if unit == "kW":
            value = F.coalesce((clean.try_cast("decimal(38,12)") / 1000).cast("double"), value / 1000)
        return F.when(clean.rlike(NUMBER), bound(value, lambda v: F.when(non_negative(v), v)))

    return bound(stripped(text), convert)


def decimal_amount(text: Column, precision: int = 28, scale: int = 10) -> Column:
    """DECIMAL of a plain number; null for anything else or what does not fit."""
    return bound(stripped(text), lambda clean: F.when(clean.rlike(NUMBER), clean.try_cast(f"decimal({precision},{scale})")))


def decimal_text(value: Column) -> Column:
    """Plain notation without an exponent."""
    return value.cast("string")


def zone(name: str | None) -> str | None:
    """A known zone's name; None stays None."""
    if name is None:
        return None
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError) as error:
        raise InvalidRequestError("unknown time zone") from error
    if not name.strip():
        raise InvalidRequestError("unknown time zone")
    return name


def _parts(text: Column) -> Column:
    """``date and hour, minute, second, fraction, zone`` of a stamp in one match; null for other texts.

    Stamps are told by the mark that the replacement puts before them, which no stamp contains.
    """
    cut = lambda clean: bound(F.regexp_replace(clean, STAMP, "\x01$1-$3-$4 $5|$7|$8|$9|$10"), lambda made: F.when((made != clean) & made.startswith("\x01"), F.split(F.substring(made, 2, 80), r"\|")))
    return bound(stripped(text), cut)


def _instants(parts: Column) -> Column:
    """``struct<aware, naive>`` of a stamp's parts: the first in UTC if there is a zone, the second as it stands if there is none."""
    local = F.concat(parts[0], F.lit(":"), F.rpad(parts[1], 2, "0"), F.lit(":"), F.rpad(parts[2], 2, "0"), F.lit("."), F.rpad(parts[3], 6, "0"))
    zone = parts[4]
    offset = F.when(zone == "Z", "+00:00").when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    aware = F.when(zone != "", F.concat(local, offset).try_cast("timestamp").cast("timestamp_ntz"))
    return F.struct(aware.alias("aware"), F.when(zone == "", local.try_cast("timestamp_ntz")).alias("naive"))


def timestamp_utc(text: Column, source_zone: str | None = None) -> Column:
    """TIMESTAMP_NTZ in UTC from ISO text with an offset, or without one if ``source_zone`` is given.

    Null for bare numbers, dates alone, impossible dates, and local times that are skipped or ambiguous.
    """
    if source_zone is None:
        return bound(_parts(text), lambda p: _instants(p)["aware"])
    if source_zone == "UTC":
        return bound(_parts(text), lambda p: bound(_instants(p), lambda i: F.coalesce(i["aware"], i["naive"])))
    place = zone(source_zone)
    return bound(_parts(text), lambda p: bound(_instants(p), lambda i: F.coalesce(i["aware"], local_to_utc(i["naive"], place))))


def utc_iso(time: Column) -> Column:
    """ISO text with ``+00:00``; microseconds only where they are not zero."""
    plain = time.cast("timestamp")
    whole = F.date_format(plain, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(F.unix_micros(plain), F.lit(1_000_000))
    return F.concat(whole, F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))), F.lit("+00:00"))


def point_uuid(namespace: uuid.UUID, document_id: Column, chunk_id: Column) -> Column:
    """UUID version 5 of the JSON list of both ids, made from SHA-1 by built-in functions."""
    inner = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("a"))), r'^\{"a":|\}$', "")
    name = F.concat(F.lit("["), inner(document_id), F.lit(","), inner(chunk_id), F.lit("]"))
    digest = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.substring(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def content_fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON object; equal for equal contents."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def correlation_id(text: Column) -> Column:
    """The id if it is well formed, else null; the caller then makes one."""
    return F.when(text.rlike(r"\A[A-Za-z0-9._:-]{1,128}\z"), text)


def clean_text(text: Column) -> Column:
    """Line ends as line feeds, without white space at both ends."""
    return stripped(F.regexp_replace(text, "\r\n?", "\n"))
