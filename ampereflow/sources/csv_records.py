"""CSV records of files of any size: quoted line breaks and broken files, without reading a file in one task.

Spark cuts files into splits at line breaks, of which some stand inside quotes. Whether a split begins inside is
known only from all splits before, so the work is a prefix scan. A first pass follows each split's lines from
both states, outside and inside quotes, and keeps where each ends: a function of two states. The functions
are composed in the order of the splits by window functions over one row a split. A second pass reads the lines again, now
from the right state. Records that lie within a split are parsed there; pieces of records that reach across splits are put
together by one key a record.

Failure is data: each split and each joined record notes its first error, the least place in a file is taken, and only what
comes before it counts.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DependencyUnavailableError
from ..shared import broadcast_within, materialize

#: States at the beginning of a line, and the end of a reading that broke off.
OUTSIDE, INSIDE, BROKEN = 0, 1, 2
DECODE, PARSE = "csv_decode_failed", "csv_parse_failed"
#: Most characters of a cell.
CELL_LIMIT = 131_072
_UNQUOTE = re.compile(rb'(?:[^"]+|"")*+')
_END = re.compile(rb"[,\r]")
_PIECES = "file string, block bigint, idx bigint, kind string, cells array<string>, raw binary"
_COLUMNS = ["file", "block", "idx", "kind", "cells", "raw"]


@dataclass(frozen=True)
class Records:
    """``rows (file, pos, cells)`` and ``errors (file, code, pos)``; a broken file has one error, at the place of the row that failed."""

    rows: DataFrame
    errors: DataFrame


def after(line: bytes, state: int) -> int:
    """The state behind a line that is read from ``state``: the next line begins outside or inside quotes, or the reading broke off."""
    if state == BROKEN or b'"' not in line:
        return state
    at, size = 0, len(line)
    while True:
        if state == INSIDE:
            at = _UNQUOTE.match(line, at).end()
            if at == size:
                return INSIDE
            at += 1
            if at == size:
                return OUTSIDE
            if line[at] not in b",\r":
                return BROKEN
            at, state = at + 1, OUTSIDE
        elif line[at : at + 1] == b'"':
            at, state = at + 1, INSIDE
        else:
            found = _END.search(line, at)
            if found is None:
                return OUTSIDE
            at = found.end()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line)`` in the order of each split; a split is told by its file and first byte."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of one split, in order; a task may hold several splits one after the other."""
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1)
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        if files[0] == files[last] and blocks[0] == blocks[last]:
            yield files[0].as_py(), blocks[0].as_py(), batch
            continue
        names, starts, begun = files.to_pylist(), blocks.to_pylist(), 0
        for i in range(1, batch.num_rows + 1):
            if i > last or (names[i], starts[i]) != (names[begun], starts[begun]):
                yield names[begun], starts[begun], batch.slice(begun, i - begun)
                begun = i


def transitions(lines: DataFrame) -> DataFrame:
    """``(file, block, from_outside, from_inside)``: where each split's reading ends, by the state in which it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "from_outside", "from_inside"]
        here, states = None, [OUTSIDE, INSIDE]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([here[0]]), pa.array([here[1]], pa.int64()), *[pa.array([s], pa.int32()) for s in states]], names=names)

        for file, block, batch in _runs(batches):
            if (file, block) != here:
                if here:
                    yield row()
                here, states = (file, block), [OUTSIDE, INSIDE]
            column = batch.column(2)
            for line in column.filter(pc.match_substring(column, b'"')).to_pylist():
                states = [after(line, s) for s in states] if states[0] != states[1] else [after(line, states[0])] * 2
        if here:
            yield row()

    return lines.mapInArrow(run, "file string, block bigint, from_outside int, from_inside int")


def beginnings(found: DataFrame) -> DataFrame:
    """``(file, block, state)`` of each split, from :func:`transitions` composed in the order of a file's blocks.

    A function of two states is constant, the identity or a swap; a reading that broke off ends everything behind it, so
    it may count as any constant. A state is then that of the last constant before, turned over by each swap since.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_outside") == INSIDE) & (F.col("from_inside") == OUTSIDE)
    same = (F.col("from_outside") == OUTSIDE) & (F.col("from_inside") == INSIDE)
    # Behind a break nothing is read, so the reading that doesn't break may stand for both.
    constant = F.when(~swap & ~same, F.when(F.col("from_outside") == BROKEN, F.col("from_inside")).otherwise(F.col("from_outside")))
    marked = found.withColumn("swaps", F.sum(swap.cast("int")).over(order)).withColumn("constant", constant)
    last = F.last(F.when(F.col("constant").isNotNull(), F.struct("constant", "swaps")), ignorenulls=True).over(before)
    done = F.coalesce(F.sum(swap.cast("int")).over(before), F.lit(0))
    state = F.pmod(F.coalesce(F.col("last.constant"), F.lit(OUTSIDE)) % 2 + done - F.coalesce(F.col("last.swaps"), F.lit(0)), F.lit(2))
    return marked.withColumn("last", last).withColumn("done", done).select("file", "block", state.cast("int").alias("state"))


def _parse(data: bytes, limit: int = CELL_LIMIT) -> tuple[list[list[str]], str | None]:
    """Rows that aren't blank of a piece that begins outside quotes, up to its first error, and the error."""
    rows: list[list[str]] = []
    error, full = None, False
    try:
        text = data.decode()
    except UnicodeDecodeError as broken:
        error, text = DECODE, data[: broken.start].decode()
    ends = io.StringIO(text, newline="")
    csv.field_size_limit(limit)
    try:
        for row in csv.reader(ends, strict=True):
            full = any(c.strip() for c in row)
            if full:
                rows.append(row)
        if error and full and not text.endswith(("\n", "\r")):
            rows.pop()  # the row that the bad byte breaks
    except csv.Error:
        error = error if ends.tell() == len(text) and error else PARSE
    return rows, error


class _Split:
    """One split read from its right state: rows, pieces of records that reach across splits, and the first error."""

    def __init__(self, file: str, block: int, state: int, limit: int):
        self.file, self.block, self.state, self.limit = file, block, state, limit
        self.begun = state  # the state in which the lines that are held began
        self.held: list[bytes] = []
        self.idx = 0
        self.broken = False

    def _row(self, kind: str, cells: list[list[str] | None], raw: bytes | None = None) -> pa.RecordBatch:
        n = len(cells)
        at = pa.array(range(self.idx, self.idx + n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([self.file] * n), pa.array([self.block] * n, pa.int64()), at, pa.array([kind] * n), pa.array(cells, pa.list_(pa.string())), pa.array([raw] * n, pa.binary())], names=_COLUMNS)

    def _records(self, data: bytes) -> Iterator[pa.RecordBatch]:
        rows, error = _parse(data, self.limit)
        if rows:
            yield self._row("row", rows)
            self.idx += len(rows)
        if error:
            yield self._row(error, [None])
            self.broken = True

    def add(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Parse what ends outside quotes; hold the lines of a record that is still open."""
        if self.broken:
            return
        start = 0
        for i, line in enumerate(lines):
            before, self.state = self.state, after(line, self.state)
            if self.state == BROKEN:
                break
            if before == INSIDE and self.state == OUTSIDE and self.begun == INSIDE:
                # The end of a record of an earlier split.
                yield self._row("head", [None], b"".join(x + b"\n" for x in [*self.held, *lines[start : i + 1]]))
                self.held, self.begun, start = [], OUTSIDE, i + 1
            elif before == OUTSIDE and self.state == INSIDE:
                # Lines before this one are whole records.
                if start < i or self.held:
                    yield from self._records(b"".join(x + b"\n" for x in [*self.held, *lines[start:i]]))
                self.held, start = [], i
            if self.broken:
                return
        rest = lines[start:]
        if self.state == OUTSIDE or self.state == BROKEN:
            if self.state == BROKEN and self.begun == INSIDE:
                # The record of an earlier split breaks here; its pieces give the error when they are put together.
                yield self._row("head", [None], b"".join(x + b"\n" for x in [*self.held, *rest]))
                self.broken = True
                return
            if self.held or rest:
                yield from self._records(b"".join(x + b"\n" for x in [*self.held, *rest]))
            self.held = []
            if self.state == BROKEN:
                self.broken = True
        else:
            self.held += rest

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held and not self.broken:
            yield self._row("whole" if self.begun == INSIDE else "tail", [None], b"".join(x + b"\n" for x in self.held))


def _pieces(lines: DataFrame, limit: int) -> DataFrame:
    """Rows of whole records, pieces of others and errors of ``lines (file, block, line, state)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for file, block, batch in _runs(batches):
            if split is None or (split.file, split.block) != (file, block):
                if split:
                    yield from split.end()
                split = _Split(file, block, batch.column(3)[0].as_py(), limit)
            yield from split.add(batch.column(2).to_pylist())
        if split:
            yield from split.end()

    return lines.mapInArrow(run, _PIECES)


def _joined(pieces: DataFrame, limit: int) -> DataFrame:
    """Rows and errors of the records that reach across splits; they take the places behind their first split's own rows.

    Pieces without a beginning, or behind an end, follow a split that broke off, and don't count.
    """
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0))
    before = F.last(F.when(F.col("kind") != "whole", F.struct("kind", "block", "idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("kind") == "tail", F.struct("block", "idx")).when(F.col("before.kind") == "tail", F.struct("before.block", "before.idx"))
    chained = pieces.filter(F.col("raw").isNotNull()).withColumn("before", before).withColumn("first", first).filter(F.col("first").isNotNull())
    whole = chained.groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("block", (F.col("kind") == "tail").alias("later"), "raw"))).alias("parts"))
    texts = whole.select("file", F.col("first.block").alias("block"), F.col("first.idx").alias("idx"), F.transform("parts", lambda p: p["raw"]).alias("raws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, idx, raws in zip(*(c.to_pylist() for c in batch.columns)):
                split = _Split(file, block, OUTSIDE, limit)
                split.idx = idx
                yield from split._records(b"".join(raws))

    return texts.mapInArrow(run, _PIECES)


def read_records(spark: SparkSession, path: str | list[str], cell_limit: int = CELL_LIMIT, broadcast_rows: int = 200_000) -> Records:
    """All records of CSV files in UTF-8, as a strict reader gives them.

    Cells may be quoted and then hold commas, line breaks and doubled quotes; records end at a line feed, a carriage
    return or both, and a byte order mark at a file's beginning is no part of it. Rows whose cells are all blank are neither kept
    nor counted; ``pos`` counts the others of a file from 1. A byte that is no UTF-8 (``csv_decode_failed``), text behind a closing quote, a quote
    that is never closed and a cell of more than ``cell_limit`` characters (``csv_parse_failed``) end a file: rows before are kept and the file has one error. A path
    that can't be read raises. Splits are found again by file and first byte; their states are broadcast if there
    are at most ``broadcast_rows``, else lines are shuffled by split and sorted.
    """
    try:
        lines = _lines(spark, path)
        found = materialize(transitions(lines), "transitions")
    except Exception as error:
        raise DependencyUnavailableError("the source can't be read") from error
    states = materialize(beginnings(found), "states").select(F.col("file").alias("__file"), F.col("block").alias("__block"), "state")
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    if states.limit(broadcast_rows + 1).count() <= broadcast_rows:
        placed = lines.join(broadcast_within(states, broadcast_rows), same)
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(states, same).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = materialize(_pieces(placed.select("file", "block", "line", "state"), cell_limit), "pieces")
    everything = materialize(pieces.filter(F.col("raw").isNull()).unionByName(_joined(pieces, cell_limit)).drop("raw"), "records")
    place = F.struct("block", "idx")
    broken = everything.filter("kind <> 'row'").groupBy("file").agg(F.min(F.struct("block", "idx", "kind")).alias("e"))
    broken = materialize(broken.select(F.col("file").alias("__file"), F.col("e.kind").alias("code"), F.struct("e.block", "e.idx").alias("end")), "broken")
    rows = everything.filter("kind = 'row'").join(broadcast_within(broken, broadcast_rows), F.col("file") == F.col("__file"), "left").filter(F.col("end").isNull() | (place < F.col("end")))
    rows = rows.select("file", "block", "idx", "cells")
    sizes = materialize(rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")), "sizes")
    running = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    offsets = materialize(sizes.select(F.col("file").alias("__file"), F.col("block").alias("__block"), running.alias("offset")), "offsets")
    numbered = rows.join(broadcast_within(offsets, broadcast_rows), same)
    totals = sizes.groupBy(F.col("file").alias("__counted")).agg(F.sum("n").alias("kept"))
    errors = broken.join(totals, F.col("__file") == F.col("__counted"), "left").select(F.col("__file").alias("file"), "code", (F.coalesce("kept", F.lit(0)) + 1).alias("pos"))
    return Records(numbered.select("file", (F.col("offset") + F.col("idx") + 1).alias("pos"), "cells"), errors)
