"""Versions of a stored table: steps up and down, a ledger, and rewrites by partition that resume.

A table at ``path`` has folders ``generation=<n>``, each partitioned by one column, and a ledger ``_versions`` of
JSON rows, which readers of the folders pass over. A step writes the next generation partition by partition while readers still see
the present one; one ledger row makes the new one current. What the ledger says is done isn't done again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, InvalidRequestError, NotFoundError
from ..shared import exists

Change = Callable[[DataFrame], DataFrame]
LEDGER = "generation int, source int, version int, part string, n bigint, digest string"
#: Partitions that are rewritten by one job and then noted in the ledger.
WAVE = 64


@dataclass(frozen=True)
class Step:
    """From the version before to ``version``. ``down`` undoes ``up``; neither moves a row to another partition.

    ``key`` are columns that no two rows may share, and ``rule`` is what every row must meet, from this version on.
    Of ``key`` the partition column must be a function, so that repeats lie in one partition.
    """

    version: int
    up: Change
    down: Change
    key: tuple[str, ...] = ()
    rule: Callable[[], Column] | None = None


def digests(rows: DataFrame, by: str) -> dict[str, tuple[int, str]]:
    """For each partition the number of its rows and the sum of their hashes, whatever their order; nulls count as values."""
    cells = [c for name in sorted(rows.columns) for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    total = F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string")
    found = rows.groupBy(F.col(by).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"), total.alias("digest"))
    return {r.part: (r.n, r.digest) for r in found.collect()}  # one row a partition


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    place = f"{path.rstrip('/')}/_versions"
    return spark.read.schema(LEDGER).json(place) if exists(spark, place) else spark.createDataFrame([], LEDGER)


def _note(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/_versions")


def _folder(path: str, generation: int) -> str:
    return f"{path.rstrip('/')}/generation={generation}"


def current(spark: SparkSession, path: str) -> tuple[int, int]:
    """The generation that readers see, and its version. A ledger row without partition makes its generation current."""
    found = _ledger(spark, path).filter("part IS NULL").agg(F.max(F.struct("generation", "version")).alias("top")).first().top
    if found is None:
        raise NotFoundError("there is no table at this path")
    return found.generation, found.version


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_folder(path, current(spark, path)[0]))


def create(rows: DataFrame, path: str, version: int, by: str) -> None:
    """A new table of ``rows`` at ``version``, partitioned by ``by``, which is never null."""
    spark = rows.sparkSession
    if exists(spark, f"{path.rstrip('/')}/_versions"):
        raise ConflictError("there is a table at this path")
    if rows.filter(F.col(by).isNull()).limit(1).count():
        raise InvalidRequestError("a row has no partition")
    rows.write.mode("overwrite").partitionBy(by).parquet(_folder(path, 0))
    _note(spark, path, [(0, None, version, None, None, None)])


def _refuse_broken(rows: DataFrame, step: Step) -> None:
    if step.rule is not None and rows.filter(~F.coalesce(step.rule(), F.lit(False))).limit(1).count():
        raise InvalidRequestError(f"a stored row breaks a rule of version {step.version}")
    if step.key and rows.groupBy(*step.key).count().filter("count > 1").limit(1).count():
        raise ConflictError(f"stored rows share a key of version {step.version}")


def _rewrite(spark: SparkSession, path: str, by: str, generation: int, version: int, change: Change, back: Change, wave: int) -> int:
    """Write the next generation from ``generation`` and make it current; its number.

    Partitions that an earlier run wrote are passed over if their rows are still the same. Every wave is read back: undoing the
    change must give the very rows it came from, else the step is refused and the table stays as it was.
    """
    stored = spark.read.parquet(_folder(path, generation))
    wanted = digests(stored, by)
    ledger = _ledger(spark, path)
    tried = ledger.filter((F.col("source") == generation) & (F.col("version") == version) & (F.col("generation") > generation)).agg(F.max("generation").alias("g")).first().g
    latest = ledger.agg(F.max("generation").alias("g")).first().g
    number = tried if tried is not None else latest + 1
    noted = ledger.filter((F.col("generation") == number) & F.col("part").isNotNull()).collect() if tried is not None else []  # one row a partition and run
    done = {r.part for r in noted if wanted.get(r.part) == (r.n, r.digest)}
    stale = {r.part for r in noted} - set(wanted)
    if stale:  # a partition that is gone since: nothing of that attempt is used
        number, done = latest + 1, set()
    rest = sorted(set(wanted) - done)
    for at in range(0, len(rest), wave):
        names = rest[at : at + wave]
        here = F.col(by).cast("string").isin(names)
        change(stored.filter(here)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(_folder(path, number))
        undone = digests(back(spark.read.parquet(_folder(path, number)).filter(here)).select(*stored.columns), by)
        if undone != {name: wanted[name] for name in names}:
            raise ConflictError(f"a partition can't be brought back from version {version}")
        _note(spark, path, [(number, generation, version, name, *wanted[name]) for name in names])
    _note(spark, path, [(number, generation, version, None, None, None)])
    return number


def migrate(spark: SparkSession, path: str, steps: Sequence[Step], target: int, by: str, wave: int = WAVE) -> int:
    """Bring the table at ``path`` to version ``target``, up or down, one step after another; the version it then has.

    A step up is refused before anything is written if stored rows break its rule or share its key. A run that breaks off leaves
    readers the last version that was reached, and the next run goes on after the last wave. An empty table has no partition and can't be
    read without its columns, so it is refused. Writers must pause: plain Parquet doesn't isolate them from a rewrite.
    """
    known = {s.version: s for s in steps}
    if len(known) != len(steps) or sorted(known) != list(range(min(known, default=1), min(known, default=1) + len(known))):
        raise InvalidRequestError("versions of the steps must follow one another")
    generation, version = current(spark, path)
    if target != version and not (known and min(known) - 1 <= min(target, version) and max(target, version) <= max(known)):
        raise NotFoundError("no steps lead to this version")
    while version != target:
        if target > version:
            step, version = known[version + 1], version + 1
            _refuse_broken(step.up(spark.read.parquet(_folder(path, generation))), step)
            generation = _rewrite(spark, path, by, generation, version, step.up, step.down, wave)
        else:
            step, version = known[version], version - 1
            generation = _rewrite(spark, path, by, generation, version, step.down, step.up, wave)
    return version


def _record_key() -> Column:
    return F.sha2(F.concat_ws("|", "consumer_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)


#: Observations: version 1 has rows alone; version 2 has each entity and instant once, finite values from zero on, and a key to look rows up by.
OBSERVATIONS = (
    Step(1, lambda rows: rows, lambda rows: rows),
    Step(
        2,
        lambda rows: rows.withColumn("record_key", _record_key()),
        lambda rows: rows.drop("record_key"),
        key=("consumer_id", "timestamp"),
        rule=lambda: (F.col("value_mw") >= 0) & (F.col("value_mw") < float("inf")),
    ),
)
