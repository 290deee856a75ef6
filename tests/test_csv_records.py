"""CSV records against Python's strict reader, at splits of any size."""

import csv
import io
import random

import pytest

from ampereflow.errors import DependencyUnavailableError
from ampereflow.functions.grid import Grid
from ampereflow.sources import csv_records, tabular


def expected(data):
    """Rows of the strict reader over the whole file, up to its first error, and the error."""
    error = None
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as broken:
        error, text = "csv_decode_failed", data[: broken.start].decode("utf-8-sig")
    rows, last = [], None
    try:
        for last in csv.reader(io.StringIO(text, newline=""), strict=True):
            if any(c.strip() for c in last):
                rows.append(last)
        if error and last and any(c.strip() for c in last) and not text.endswith(("\n", "\r")):
            rows.pop()
    except csv.Error:
        error = error or "csv_parse_failed"
    return rows, error


@pytest.fixture
def splits(spark):
    """Sets the size of the splits; the default comes back afterwards."""
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "1"), spark.conf.set("spark.sql.files.minPartitionNum", "1"))
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def found(spark, path, **options):
    got = csv_records.read_records(spark, path, **options)
    rows, errors = got.rows.collect(), got.errors.collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, list(r.cells)))
    for name, of_file in out.items():
        assert [p for p, _ in sorted(of_file)] == list(range(1, len(of_file) + 1)), name
    return {n: [c for _, c in sorted(x)] for n, x in out.items()}, {e.file.rsplit("/", 1)[1]: (e.code, e.pos) for e in errors}


CASES = {
    "plain": b"a,b\n1,2\n3,4",
    "mark": b"\xef\xbb\xbf\"a\",b\r\n1,2\r\n",
    "breaks": b'a,"x\ny"\n"1\r\n2","3""\n""4"\n\n,,\n" ",\n5,6\n',
    "only-cr": b'a,b\r"x\ry",2\r3,4\r',
    "mixed": b'a,b\n"q\n",1\r"r\n\n\ns",2\r\n"",""\n"",x\n',
    "long-cell": b'a,b\n"' + b"line of a long cell\n" * 60 + b'",end\nlast,row\n',
    "quote-within": b'a"b,c\n1"2,"3"\n""\n',
    "behind-quote": b'a,b\n1,2\n"x"y,3\n4,5\n"',
    "behind-quote-late": b'a,b\n"x\nx\nx\nx\nx"y,3\n4,5\n6,7\n',
    "never-closed": b'a,b\n1,2\n"x,3\n4,5\n6,7\n8,9\n',
    "bad-byte": b"a,b\n1,2\n3,\xff4\n5,6\n7,8\n",
    "bad-byte-in-cell": b'a,b\n1,2\n"3\n\xc3\n4",5\n7,8\n',
    "bad-byte-first": b"\xfe\xff\na,b\n",
    "bad-after-parse": b'a,b\n"x"y\n1,2\n\xff\n',
    "empty": b"",
    "blank": b"\n\n , \n",
    "unicode": "ա,é\n ,　\n ,x\n\x85,y\n".encode(),
    "nul": b"a,b\n\x00,c\n",
}


@pytest.mark.parametrize("size", [1 << 20, 150])
def test_cases_equal_the_strict_reader(spark, tmp_path, splits, size):
    for name, data in CASES.items():
        (tmp_path / name).write_bytes(data)
    splits(size)
    rows, errors = found(spark, str(tmp_path))
    for name, data in CASES.items():
        want, error = expected(data)
        if name == "bad-after-parse":
            error = "csv_parse_failed"  # comes first
        assert rows.get(name, []) == want, name
        assert errors.get(name) == ((error, len(want) + 1) if error else None), name


def random_csv(rng, rows):
    ends = rng.choice([["\n"], ["\r\n"], ["\n", "\r\n", "\r"]])
    out = []
    for _ in range(rows):
        cells = []
        for _ in range(rng.randint(1, 4)):
            text = "".join(rng.choice(['"', ",", "\n", "\r\n", "\r", "a", "bc", "é", " ", "word " * 5]) for _ in range(rng.randint(0, 8)))
            plain = not any(c in text for c in '",\r\n')
            cells.append(text if plain and rng.random() < 0.7 else '"' + text.replace('"', '""') + '"')
        out.append(",".join(cells) + rng.choice(ends))
    text = "".join(out)
    if rng.random() < 0.4:  # break it somewhere
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(['"', '"x"y', "\n\"", ""]) + text[at:]
    data = text.encode()
    if rng.random() < 0.3:
        at = rng.randrange(len(data))
        data = data[:at] + b"\xff" + data[at:]
    return data


def test_random_files_at_many_split_sizes(spark, tmp_path, splits):
    rng = random.Random(11)
    files = {f"f{i:02}": random_csv(rng, rng.randint(1, 20)) for i in range(12)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for size, limit in ((120, 200_000), (400, 0)):
        splits(size)
        rows, errors = found(spark, str(tmp_path), broadcast_rows=limit)
        for name, data in files.items():
            want, error = expected(data)
            assert rows.get(name, []) == want, (name, size, data)
            assert (name in errors) == bool(error), (name, size, data)
            if error:
                assert errors[name][1] == len(want) + 1


def test_states_compose_like_a_plain_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for f in range(6):
        state = 0
        for block in range(25):
            to = rng.choice([(0, 1), (1, 0), (0, 0), (1, 1), (0, 1), (2, 1), (0, 2)])
            rows.append((f"f{f}", block, *to))
            want[f"f{f}", block] = state
            state = to[state] if state != 2 else 2
    got = {(r.file, r.block): r.state for r in csv_records.beginnings(spark.createDataFrame(rows, "file string, block bigint, from_outside int, from_inside int")).collect()}
    for f in range(6):
        for block in range(25):
            if want[f"f{f}", block] == 2:
                break
            assert got[f"f{f}", block] == want[f"f{f}", block]


def test_a_field_beyond_the_limit_breaks_the_file(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a,b\n1,2\n" + b"x" * 131_073 + b",3\n4,5\n")
    rows, errors = found(spark, str(tmp_path / "f"))
    assert rows == {"f": [["a", "b"], ["1", "2"]]} and errors == {"f": ("csv_parse_failed", 3)}


def test_unreadable_path(spark, tmp_path):
    with pytest.raises(DependencyUnavailableError):
        csv_records.read_records(spark, str(tmp_path / "absent"))


HEAD = b"consumer_id,timestamp,Consumption_MW\n"
GOOD = b"c-1,2026-09-05T00:00:00Z,1\nc-1,2026-09-05T01:00:00Z,\"2\"\n"


@pytest.mark.parametrize("tail,code", [(b"c-1,2026-09-05T02:00:00Z,\xff\nc-1,2026-09-05T03:00:00Z,1\n", "csv_decode_failed"), (b'c-1,2026-09-05T02:00:00Z,"1\nc-1,2026-09-05T03:00:00Z,1\n', "csv_parse_failed"), (b'"c-1"x,2026-09-05T02:00:00Z,1\n', "csv_parse_failed")])
def test_ingest_keeps_rows_before_the_break(spark, tmp_path, splits, tail, code):
    (tmp_path / "f.csv").write_bytes(HEAD + GOOD + b"bad\n" + tail)
    splits(120)
    got = tabular.ingest_csv(spark, str(tmp_path / "f.csv"), "src", grid=Grid(3_600_000_000))
    assert [(r.pos, r.value_mw) for r in got.records.orderBy("pos").collect()] == [(2, 1.0), (3, 2.0)]
    assert {r.record_id: (r.code, r.payload_reference) for r in got.dead_letters.collect()} == {"src:row:4": ("row_shape_invalid", "csv://src/row/4"), "src:source": (code, "csv://src/source")}
    notes = [(r.code, r.severity) for r in got.diagnostics.collect()]
    assert (code, "error") in notes and all("\xff" not in r.message for r in got.diagnostics.collect())


def test_a_break_before_the_header(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"\xff" + HEAD + GOOD)
    got = tabular.ingest_csv(spark, str(tmp_path / "f.csv"), "src")
    assert got.records.count() == 0
    assert [(r.record_id, r.code) for r in got.dead_letters.collect()] == [("src:source", "csv_decode_failed")]


def test_quoted_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b'consumer_id,timestamp,"value\nmw",note\n"c\n1",2026-09-05T00:00:00Z,1,"a\n\n""b"""\n')
    got = tabular.ingest_csv(spark, str(tmp_path / "f.csv"), "src")
    assert [(r.pos, r.consumer_id, r.value_mw) for r in got.records.collect()] == [(2, "c\n1", 1.0)]
