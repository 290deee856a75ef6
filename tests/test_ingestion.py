import pytest

from ampereflow.errors import DependencyUnavailableError, InvalidRequestError
from ampereflow.functions.grid import Grid
from ampereflow.sources import tabular
from ampereflow.sources.headers import Field, Resolver, consumption_fields, diagnostics, normalize_name, require_consumption_fields, safe_units

HOUR = Grid(3_600_000_000)


def resolved(headers, unit="MW", fields=None):
    resolver = Resolver(fields or consumption_fields(unit))
    return safe_units(resolver, resolver.resolve(headers), unit)


def csv(tmp_path, text, name="f.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_names_are_folded():
    assert normalize_name("  Straße__№ 1 ") == "strasse no 1"
    assert normalize_name("Consumption-MW") == normalize_name("consumption  mw") == "consumption mw"


def test_exact_alias_and_fuzzy_headers():
    assert resolved(["consumer_id", "timestamp", "Consumption_MW"]).columns() == {"consumer_id": 0, "timestamp": 1, "value_mw": 2}
    found = resolved(["Consumer ID", "Timestamp", "Consumpton_MW"])
    assert found.usable and found.matches[2].status == "fuzzy" and found.matches[2].confidence >= 0.85
    own = consumption_fields()[:2] + (Field("value_mw", ("սպառում",)),)
    assert resolved(["consumer_id", "timestamp", "ՍՊԱՌՈՒՄ"], fields=own).usable


@pytest.mark.parametrize("header", ["Consumption_kW", "Consumption_kWh", "Consumption_W", "Consumption_MWh", "Consumption_MW_h", "Consumption_MW-hour"])
def test_unsafe_units_are_refused(header):
    found = resolved(["consumer_id", "timestamp", header])
    assert found.missing == ("value_mw",) and not found.usable


def test_unit_follows_the_configuration():
    assert resolved(["consumer_id", "timestamp", "Consumption_kW"], "kW").usable
    assert not resolved(["consumer_id", "timestamp", "Consumption_MW"], "kW").usable
    assert not resolved(["consumer_id", "timestamp", "value_mw"], "kW").usable
    with pytest.raises(InvalidRequestError):
        consumption_fields("GW")


def test_ambiguity_collision_and_configuration():
    resolver = Resolver((Field("abcdefgh1"), Field("abcdefgh2")))
    assert resolver.match("abcdefgh").status == "ambiguous"
    found = resolved(["consumer_id", "Consumer-ID", "timestamp", "value_mw"])
    assert found.collisions == ("consumer_id",) and {"code": "schema_field_collision", "severity": "error", "field_name": "consumer_id"} in diagnostics(found)
    for fields in ((), (Field("a"), Field("a")), (Field("a", ("x",)), Field("b", ("X",))), (Field(" "),)):
        with pytest.raises(InvalidRequestError):
            Resolver(fields)
    with pytest.raises(InvalidRequestError):
        require_consumption_fields((Field("consumer_id"),))


def test_csv_end_to_end(spark, tmp_path):
    text = (
        "﻿consumer_id,timestamp,Consumption_MW,note\r\n"
        "customer-1,2026-09-05T00:00:00+04:00,12.5,a\r\n"
        ",,,\r\n\r\n"
        'customer-1,2026-09-04T21:00:00Z," 7 ","x, ""y"""\r\n'
        "customer-1,2026-09-05T01:00:00,1\r\n"
        "customer-1,2026-09-05,1,z\r\n"
        "customer-1,2026-09-05T02:00:00Z,12.5d,z\r\n"
        "customer-1,2026-09-05T03:00:00Z,NaN,z\r\n"
        "customer-1,2026-09-05T04:00:00Z,-1,z\r\n"
        "customer-2,2026-09-05T04:00:00Z,1,z\r\n"
        "customer-2,2026-09-05T08:00:00+04:00,1,z\r\n"
        "customer-1,2026-09-05T04:30:00Z,1,z\r\n"
        "customer-1,2026-09-05T05:00:00Z,0,z\r\n"
    )
    got = tabular.ingest_csv(spark, csv(tmp_path, text), "src", grid=HOUR)
    rows = [(r.pos, r.consumer_id, str(r.timestamp), r.value_mw) for r in got.records.orderBy("pos").collect()]
    assert rows == [(2, "customer-1", "2026-09-04 20:00:00", 12.5), (3, "customer-1", "2026-09-04 21:00:00", 7.0), (12, "customer-1", "2026-09-05 05:00:00", 0.0)]
    letters = {r.record_id: r.code for r in got.dead_letters.collect()}
    assert letters == {"src:row:4": "row_shape_invalid", **{f"src:row:{i}": "row_validation_failed" for i in (5, 6, 7, 8)}, "src:row:9": "series_duplicate", "src:row:10": "series_duplicate", "src:row:11": "series_misaligned"}
    assert {r.payload_reference for r in got.dead_letters.collect()} >= {"csv://src/row/4"}
    notes = got.diagnostics.collect()
    assert [n.message for n in notes if n.code == "series_gap"] == ["7 intervals are missing"]
    assert [n.severity for n in notes if n.code == "schema_field_unresolved"] == ["warning"]
    assert not any("12.5d" in str(n) or "customer" in str(n) for n in notes)


def test_bad_header_gives_one_letter_and_no_rows(spark, tmp_path):
    got = tabular.ingest_csv(spark, csv(tmp_path, "a,b\n1,2\n"), "src")
    assert got.records.count() == 0 and [r.record_id for r in got.dead_letters.collect()] == ["src:schema"]
    got = tabular.ingest_csv(spark, csv(tmp_path, "", "empty.csv"), "src")
    assert got.records.count() == 0 and got.dead_letters.count() == 1
    with pytest.raises(DependencyUnavailableError):
        tabular.ingest_csv(spark, str(tmp_path / "absent.csv"), "src")


def test_rows_are_numbered_over_all_parts_of_a_file(spark, tmp_path):
    path = csv(tmp_path, "consumer_id,timestamp,value_mw\n" + "".join(f"c,2026-01-01T{i % 24:02}:00:00Z,{i}\n\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        _, rows = tabular.read_csv(spark, path)
        found = {r.pos: r.cells for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found) == list(range(2, 502)) and all(found[i + 2][2] == str(i) for i in range(500))


def test_source_zone_and_ambiguous_times(spark):
    rows = spark.createDataFrame([(i, ["c", t, "1"]) for i, t in enumerate(["2026-07-01T02:00:00", "2026-10-25T02:30:00", "2026-03-29T02:30:00", "2026-10-25T02:30:00+01:00", "1234", "2026-13-01T00:00:00"])], "pos bigint, cells array<string>")
    found = {r.pos: r for r in tabular.route(rows, 3, {"consumer_id": 0, "timestamp": 1, "value_mw": 2}, source_zone="Europe/Berlin").collect()}
    assert str(found[0].timestamp) == "2026-07-01 00:00:00" and str(found[3].timestamp) == "2026-10-25 01:30:00"
    assert [found[i].code for i in range(6)] == [None, "row_validation_failed", "row_validation_failed", None, "row_validation_failed", "row_validation_failed"]
    with pytest.raises(InvalidRequestError):
        tabular.ingest(spark, ["consumer_id", "timestamp", "value_mw"], rows, "s", source_zone="No/Where")


def test_stamps_are_read_like_iso_text(spark):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from ampereflow.functions.normalize import timestamp_utc

    texts = ["2026-09-05T00:00:00+04:00", "20260905T000000Z", "2026-09-05T00", "2026-09-05 01:02", "2026-09-05T0102", "2026-09-05T01:02:03.5", "2026-09-05T01:02:03,123456789", "2026-09-05T01:02:03+04", "2026-09-05T01:02:03-0330", "2026-0905T00:00", "2026-09-05T01:0203", "2026-02-30T00:00", "2026-09-05T25:00", "2026-09-05", "1234", "12.5", "", "nonsense T"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", timestamp_utc(F.col("t"), "UTC").alias("u")).collect()
    for r in found:
        try:
            value = datetime.fromisoformat(texts[r.i]) if "T" in texts[r.i] or " " in texts[r.i] else None
        except ValueError:
            value = None
        if value is not None and value.tzinfo:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        assert r.u == value, texts[r.i]


def test_kilowatts(spark):
    rows = spark.createDataFrame([(2, ["c", "2026-07-01T02:00:00Z", "1500"]), (3, ["c", "2026-07-01T03:00:00Z", "1e3"])], "pos bigint, cells array<string>")
    got = tabular.ingest(spark, ["consumer_id", "timestamp", "Consumption_kW"], rows, "s", unit="kW")
    assert sorted(r.value_mw for r in got.records.collect()) == [1.0, 1.5]


def test_xlsx_needs_its_reader(spark, tmp_path):
    try:
        import openpyxl
    except ImportError:
        with pytest.raises(DependencyUnavailableError):
            tabular.ingest_xlsx(spark, str(tmp_path / "x.xlsx"), "s")
        return
    book = openpyxl.Workbook()
    book.active.append(["consumer_id", "timestamp", "value_mw", None])
    book.active.append(["c", "2026-07-01T02:00:00Z", 2])
    book.save(tmp_path / "x.xlsx")
    assert tabular.ingest_xlsx(spark, str(tmp_path / "x.xlsx"), "s").records.count() == 1
