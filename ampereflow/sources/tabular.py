"""Consumption files to validated records, diagnostics and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DependencyUnavailableError, InvalidRequestError
from ..functions.grid import Grid
from ..functions.normalize import power_mw, timestamp_utc, zone
from ..operators.validation import gaps, issues
from ..schemas import stripped
from . import csv_records
from .headers import Resolution, Resolver, consumption_fields, diagnostics, require_consumption_fields, safe_units

DIAGNOSTIC_SCHEMA = "code string, message string, severity string, field_name string"
LETTER_SCHEMA = "record_id string, source_name string, adapter_name string, code string, payload_reference string"


@dataclass(frozen=True)
class Ingested:
    """What one file gave: records, diagnostics and dead letters."""

    records: DataFrame
    diagnostics: DataFrame
    dead_letters: DataFrame
    schema: Resolution | None = None


def read_csv(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header cells, and ``(pos, cells)`` of the data rows before the first error."""
    return read_broken_csv(spark, path)[:2]


def read_broken_csv(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Header cells, ``(pos, cells)`` of the data rows, and ``(code)`` of what broke the file, if anything did.

    ``pos`` is the logical row, the header being 1; blank rows are neither kept nor counted. The file is
    split and parsed by Spark (:mod:`csv_records`), so no task sees the whole file.
    """
    found = csv_records.read_records(spark, path)
    first = found.rows.filter("pos = 1").limit(1).collect()
    return list(first[0].cells) if first else [], found.rows.filter("pos > 1").select("pos", "cells"), found.errors.select("code")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[list[str], DataFrame]:
    """Header cells and ``(pos, cells)`` of a worksheet, if the optional reader is installed.

    A named sheet must exist. Blank cells at the end of the header are cut off. Workbooks are small by
    format (2^20 rows) and are read on the driver.
    """
    try:
        from openpyxl import load_workbook
    except ImportError as error:
        raise DependencyUnavailableError("no spreadsheet reader is installed") from error
    try:
        book = load_workbook(path, read_only=True, data_only=True)
    except Exception as error:
        raise DependencyUnavailableError("the source can't be read") from error
    if sheet is not None and sheet not in book.sheetnames:
        raise InvalidRequestError("the worksheet does not exist")
    rows = [[None if c is None else c.isoformat() if hasattr(c, "isoformat") else str(c) for c in r] for r in (book[sheet] if sheet else book.active).iter_rows(values_only=True)]
    rows = [r for r in rows if any(c is not None and str(c).strip() for c in r)]
    if not rows:
        return [], spark.createDataFrame([], "pos bigint, cells array<string>")
    header = list(rows[0])
    while header and not (header[-1] or "").strip():
        header.pop()
    data = [(i, [*r[: max(len(header), len(r))]]) for i, r in enumerate(rows[1:], 2)]
    return [h or "" for h in header], spark.createDataFrame(data, "pos bigint, cells array<string>")


def route(rows: DataFrame, width: int, columns: dict[str, int], unit: str = "MW", source_zone: str | None = None, longer_ok: bool = False) -> DataFrame:
    """``(pos, consumer_id, timestamp, value_mw, code)`` of each row; ``code`` is null for a good row.

    ``row_shape_invalid`` for a wrong number of cells, ``row_validation_failed`` if a cell does not
    convert; one bad row never stops others.
    """
    shape = F.size("cells") < width if longer_ok else F.size("cells") != width
    cell = lambda name: F.get("cells", columns[name])
    consumer = stripped(cell("consumer_id"))
    time, value = timestamp_utc(cell("timestamp"), source_zone), power_mw(cell("value_mw"), unit)
    rows = rows.select("pos", shape.alias("__shape"), consumer.alias("consumer_id"), time.alias("timestamp"), value.alias("value_mw"))
    good = (F.coalesce("consumer_id", F.lit("")) != "") & F.col("timestamp").isNotNull() & F.col("value_mw").isNotNull()
    code = F.when(F.col("__shape"), "row_shape_invalid").when(~good, "row_validation_failed")
    return rows.select("pos", "consumer_id", "timestamp", "value_mw", code.alias("code"))


def ingest(spark: SparkSession, header: list[str], rows: DataFrame, source: str, scheme: str = "csv", broken: DataFrame | None = None, unit: str = "MW", source_zone: str | None = None, grid: Grid | None = None, resolver: Resolver | None = None) -> Ingested:
    """Records, diagnostics and dead letters of a file's header and rows.

    A header that can't be resolved gives one dead letter and no rows. Rows are converted one by one;
    duplicates and, with a ``grid``, rows off it are rejected; gaps among the survivors are diagnosed
    without a dead letter. ``broken`` holds the codes of errors that ended the source early: each gives a
    diagnostic and a dead letter of the source, and rows before it are treated as usual. Messages are
    constant and quote no cell.
    """
    zone(source_zone)
    resolver = resolver or Resolver(consumption_fields(unit))
    require_consumption_fields(resolver.fields)
    found = safe_units(resolver, resolver.resolve(header), unit)
    broken = spark.createDataFrame([], "code string") if broken is None else broken
    error = lambda rows, field=None: rows.select("code", F.translate("code", "_", " ").alias("message"), F.lit("error").alias("severity"), F.lit(field).cast("string").alias("field_name"))
    of_source = broken.select(F.lit(f"{source}:source").alias("record_id"), F.lit(source).alias("source_name"), F.lit(scheme).alias("adapter_name"), "code", F.lit(f"{scheme}://{source}/source").alias("payload_reference"))
    notes = [(d["code"], d["code"].replace("_", " "), d["severity"], d["field_name"]) for d in diagnostics(found)]
    noted = spark.createDataFrame(notes, DIAGNOSTIC_SCHEMA)
    nothing = spark.createDataFrame([], "pos bigint, consumer_id string, timestamp timestamp_ntz, value_mw double")
    if not header and not rows.limit(1).count() and broken.limit(1).count():
        return Ingested(nothing, error(broken), of_source, None)  # the source broke before its header
    if not found.usable:
        letter = [(f"{source}:schema", source, scheme, "schema_invalid", f"{scheme}://{source}/header")]
        return Ingested(nothing, noted, spark.createDataFrame(letter, LETTER_SCHEMA), found)
    routed = route(rows, len(header), found.columns(), unit, source_zone, longer_ok=scheme == "excel")
    judged = issues(routed.filter("code is null").drop("code"), grid)
    bad = routed.filter("code is not null").select("pos", "code").unionByName(judged.filter("issue is not null").select("pos", F.concat(F.lit("series_"), "issue").alias("code")))
    pos = F.col("pos").cast("string")
    letters = bad.select(F.concat(F.lit(f"{source}:row:"), pos).alias("record_id"), F.lit(source).alias("source_name"), F.lit(scheme).alias("adapter_name"), "code", F.concat(F.lit(f"{scheme}://{source}/row/"), pos).alias("payload_reference"))
    records = judged.filter("issue is null").select("pos", "consumer_id", "timestamp", "value_mw")
    letters = letters.unionByName(of_source)
    noted = noted.unionByName(error(bad)).unionByName(error(broken))
    if grid:
        missing = gaps(records, grid)
        noted = noted.unionByName(missing.select(F.lit("series_gap").alias("code"), "message", F.lit("error").alias("severity"), F.lit("timestamp").alias("field_name")))
    return Ingested(records, noted, letters, found)


def ingest_csv(spark: SparkSession, path: str, source: str, **options) -> Ingested:
    header, rows, broken = read_broken_csv(spark, path)
    return ingest(spark, header, rows, source, "csv", broken=broken, **options)


def ingest_xlsx(spark: SparkSession, path: str, source: str, sheet: str | None = None, **options) -> Ingested:
    return ingest(spark, *read_xlsx(spark, path, sheet), source, "excel", **options)


def column_of(rows: DataFrame, columns: dict[str, int]) -> list[Column]:
    """Projection of cells by a resolved header."""
    return [F.get("cells", i).alias(name) for name, i in columns.items()]
