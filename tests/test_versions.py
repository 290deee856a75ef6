from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ampereflow.errors import ConflictError, InvalidRequestError, NotFoundError
from ampereflow.sources import versions

SCHEMA = "consumer_id string, timestamp timestamp_ntz, value_mw double"


def made(spark, path, rows, version=1):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("timestamp"))
    versions.create(frame, path, version, "day")
    return sorted(map(tuple, frame.select(*frame.columns[:3]).collect()))


def content(spark, path):
    return sorted(map(tuple, versions.read(spark, path).select("consumer_id", "timestamp", "value_mw").collect()))


def days(count):
    return [(c, datetime(2026, 1, d, 5), float(d)) for d in range(1, count + 1) for c in ("a", "b")]


def test_up_and_down_leave_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = made(spark, path, days(7))
    assert versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day", wave=3) == 2
    assert versions.current(spark, path)[1] == 2 and content(spark, path) == rows
    keys = versions.read(spark, path).select("record_key").distinct()
    assert keys.count() == len(rows) and keys.filter("record_key IS NULL").count() == 0
    assert versions.migrate(spark, path, versions.OBSERVATIONS, 1, "day") == 1
    assert "record_key" not in versions.read(spark, path).columns and content(spark, path) == rows
    before = versions.current(spark, path)
    assert versions.migrate(spark, path, versions.OBSERVATIONS, 1, "day") == 1 and versions.current(spark, path) == before


def test_an_interrupted_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = made(spark, path, days(6))
    note, notes = versions._note, []

    def failing(spark, path, entries):
        if len(notes) == 2:
            raise OSError("lost")
        notes.append([e[3] for e in entries])
        note(spark, path, entries)

    monkeypatch.setattr(versions, "_note", failing)
    with pytest.raises(OSError):
        versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day", wave=2)
    monkeypatch.setattr(versions, "_note", lambda s, p, e: (notes.append([x[3] for x in e]), note(s, p, e)))
    assert versions.current(spark, path) == (0, 1) and content(spark, path) == rows
    assert versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day", wave=2) == 2
    assert notes == [["2026-01-01", "2026-01-02"], ["2026-01-03", "2026-01-04"], ["2026-01-05", "2026-01-06"], [None]]
    assert versions.current(spark, path) == (1, 2) and content(spark, path) == rows


def test_a_partition_that_changed_since_is_written_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = made(spark, path, days(3))
    note = versions._note
    monkeypatch.setattr(versions, "_note", lambda s, p, e: (_ for _ in ()).throw(OSError("lost")) if e[0][3] is None else note(s, p, e))
    with pytest.raises(OSError):
        versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day")
    late = ("c", datetime(2026, 1, 2, 7), 9.0)
    extra = spark.createDataFrame([late], SCHEMA).withColumn("day", F.to_date("timestamp"))
    extra.write.mode("append").partitionBy("day").parquet(f"{path}/generation=0")
    monkeypatch.setattr(versions, "_note", note)
    versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day")
    assert content(spark, path) == sorted([*rows, late])


@pytest.mark.parametrize("bad, error", [([("a", datetime(2026, 1, 1), 1.0)] * 2, ConflictError), ([("a", datetime(2026, 1, 1), -1.0)], InvalidRequestError), ([("a", datetime(2026, 1, 1), float("nan"))], InvalidRequestError), ([("a", datetime(2026, 1, 1), None)], InvalidRequestError)])
def test_rows_that_break_a_version_stop_it(spark, tmp_path, bad, error):
    path = str(tmp_path / "t")
    made(spark, path, bad)
    with pytest.raises(error):
        versions.migrate(spark, path, versions.OBSERVATIONS, 2, "day")
    assert versions.current(spark, path) == (0, 1)


def test_a_step_that_loses_something_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = made(spark, path, days(2))
    lossy = versions.Step(2, lambda r: r.withColumn("value_mw", F.floor("value_mw") % 2 + 0.0), lambda r: r)
    with pytest.raises(ConflictError):
        versions.migrate(spark, path, [lossy], 2, "day")
    assert versions.current(spark, path) == (0, 1) and content(spark, path) == rows


def test_paths_and_versions_are_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(NotFoundError):
        versions.read(spark, path)
    made(spark, path, days(1))
    with pytest.raises(ConflictError):
        made(spark, path, days(1))
    with pytest.raises(NotFoundError):
        versions.migrate(spark, path, versions.OBSERVATIONS, 3, "day")
    with pytest.raises(InvalidRequestError):
        versions.migrate(spark, path, [versions.OBSERVATIONS[0], versions.Step(3, lambda r: r, lambda r: r)], 1, "day")
    with pytest.raises(InvalidRequestError):
        versions.create(spark.createDataFrame([("a", None, 1.0)], SCHEMA).withColumn("day", F.to_date("timestamp")), str(tmp_path / "u"), 1, "day")
