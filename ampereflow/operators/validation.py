"""Checks of whole series: duplicates, grid, gaps, chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..functions.grid import Grid
from ..series import LOAD, Series

#: Grid steps in one bucket of a gap search.
BUCKET = 1024


def issues(rows: DataFrame, grid: Grid | None = None, series: Series = LOAD, pos: str = "pos") -> DataFrame:
    """``rows`` with ``issue``: ``duplicate``, ``misaligned`` or null.

    Every member of a group of equal entity and instant is a duplicate, exact copies too; that beats
    being off the grid. Only keys that repeat are joined back, after counting them before the shuffle.
    """
    sizes = rows.groupBy(*series.row).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    copies = sizes.select(*[F.col(c).alias(f"__{c}") for c in series.row])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in series.row]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    marked = rows.join(copies.withColumn("__copy", F.lit(True)), condition, "left")
    off = ~grid.aligned(F.col(series.time)) if grid else F.lit(False)
    issue = F.when(F.col("__copy"), "duplicate").when(off, "misaligned")
    return marked.select(*rows.columns, issue.alias("issue"))


def neighbour(rows: DataFrame, keys: tuple[str, ...], place: Column, width: int, column: str, ahead: bool) -> DataFrame:
    """``rows`` with ``__near``: ``column`` of the row after (``ahead``) or before, by ``place``, of the same keys.

    Places are unique, so a bucket of ``width`` places holds at most as many rows, and rows are sorted
    by bucket instead of by whole entities. Across buckets the neighbour is the edge of the next bucket
    that has rows; only one row a bucket is sorted by entity for that.
    """
    placed = rows.withColumn("__place", place).withColumn("__bucket", F.floor(F.col("__place") / width))
    inner = Window.partitionBy(*keys, "__bucket").orderBy("__place")
    outer = Window.partitionBy(*keys).orderBy("__b")
    edge = (F.min_by if ahead else F.max_by)(F.col(column), F.col("__place"))
    edges = placed.groupBy(*keys, F.col("__bucket").alias("__b")).agg(edge.alias("__edge"))
    step = F.lead if ahead else F.lag
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], "__b", step("__edge").over(outer).alias("__edge"))
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = placed.withColumn("__inner", step(column).over(inner)).join(edges, same)
    return joined.select(*rows.columns, F.coalesce("__inner", "__edge").alias("__near"))


def gaps(rows: DataFrame, grid: Grid, series: Series = LOAD) -> DataFrame:
    """Missing ranges between neighbours: keys, ``first_missing, last_missing, missing, message``.

    ``rows`` are survivors of ``issues``. Nothing is inferred before the first or after the last
    instant, and nothing is filled in.
    """
    place = F.unix_micros(F.col(series.time).cast("timestamp"))
    near = neighbour(rows.select(*series.row), series.keys, place, grid.step_us * BUCKET, series.time, ahead=True)
    steps = grid.steps_between(F.col(series.time), F.col("__next"))
    wide = near.withColumnRenamed("__near", "__next").withColumn("__steps", steps).filter("__steps > 1")
    missing = F.col("__steps") - 1
    text = F.concat(missing.cast("string"), F.when(missing == 1, " interval is missing").otherwise(" intervals are missing"))
    return wide.select(
        *series.keys,
        grid.offset(F.col(series.time), F.lit(1)).cast("timestamp_ntz").alias("first_missing"),
        grid.offset(F.col("__next"), F.lit(-1)).cast("timestamp_ntz").alias("last_missing"),
        missing.alias("missing"),
        text.alias("message"),
    )


def dead_letters(rows: DataFrame, source: str, scheme: str = "csv") -> DataFrame:
    """A dead letter for each row with an issue: ``record_id, payload_reference, code``."""
    pos = F.col("pos").cast("string")
    return rows.filter("issue is not null").select(
        F.concat(F.lit(f"{source}:row:"), pos).alias("record_id"),
        F.concat(F.lit(f"{scheme}://{source}/row/"), pos).alias("payload_reference"),
        F.concat(F.lit("series_"), "issue").alias("code"),
    )


def repeated_instants(rows: DataFrame, series: Series = LOAD) -> DataFrame:
    """Entities and instants that occur more than once, with ``n``."""
    return rows.groupBy(*series.row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def chronology(rows: DataFrame, series: Series = LOAD, pos: str = "pos") -> DataFrame:
    """Per entity, the first place where time does not increase along ``pos``: ``pos, violation``.

    ``violation`` is ``duplicate`` for an equal instant and ``out_of_order`` for an earlier one.
    """
    near = neighbour(rows.select(*series.row, pos), series.keys, F.col(pos).cast("bigint"), BUCKET * 64, series.time, ahead=False)
    before = near.withColumnRenamed("__near", "__before").filter(F.col("__before") >= F.col(series.time))
    kind = F.when(F.col("__before") == F.col(series.time), "duplicate").otherwise("out_of_order")
    return before.groupBy(*series.keys).agg(F.min(F.struct(F.col(pos).alias("pos"), kind.alias("violation"))).alias("v")).select(*series.keys, "v.pos", "v.violation")


def entities(rows: DataFrame, series: Series = LOAD) -> DataFrame:
    """One row: how many ``entities`` the rows belong to, and whether that is ``mixed``."""
    return rows.select(*series.keys).distinct().agg(F.count(F.lit(1)).alias("entities")).select("entities", (F.col("entities") > 1).alias("mixed"))


def require_one_entity(rows: DataFrame, series: Series) -> None:
    """Rows of more than one entity are refused."""
    if rows.select(*series.keys).distinct().limit(2).count() > 1:
        raise InvalidRequestError("rows belong to more than one entity")


def require_unique(rows: DataFrame, series: Series) -> None:
    if repeated_instants(rows, series).limit(1).count():
        raise InvalidRequestError("an instant occurs more than once")


def require_chronology(rows: DataFrame, series: Series, pos: str = "pos") -> None:
    found = chronology(rows, series, pos).orderBy("pos").limit(1).collect()
    if found:
        raise InvalidRequestError("instants repeat" if found[0].violation == "duplicate" else "instants are out of order")
