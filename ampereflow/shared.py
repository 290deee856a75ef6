"""Tables in the folder that the driver and all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one
    process is a temporary folder made and set instead; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="ampereflow-")
            context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage, is computed once however often it is read, and survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged for a shuffled join.

    ``df`` should be a written table, so that counting costs no recomputation.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hadoop_path(spark: SparkSession, path: str):
    """``path`` as Hadoop's, with its file system: whatever store Spark can write to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = hadoop_path(spark, path)
    return system.exists(place)


def publish(rows: DataFrame, path: str, check: Callable[[DataFrame], None], *, by: str | None = None, kind: str = "parquet") -> str:
    """Add ``rows`` to the table of batches at ``path`` as one batch, or not at all; the batch's name.

    The rows are written to a folder of their own under ``path/_staging``, which readers of the table pass over, read
    back there and given to ``check``. Only if that returns is the folder moved into place as ``path/batch=<name>``, by
    one rename, so readers see all of a batch or none of it, and a run that breaks off, at any time, leaves the table as it
    was. ``by`` names a column whose values become folders within the batch. What a failed run staged is deleted, if it still can be.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    root = path.rstrip("/")
    staged = f"{root}/_staging/{name}"
    from_place, system = hadoop_path(spark, staged)
    try:
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.format(kind).save(staged)
        check(spark.read.schema(rows.schema).format(kind).load(staged))
        to_place, _ = hadoop_path(spark, f"{root}/batch={name}")
        if not system.rename(from_place, to_place):
            raise OSError("the staged batch can't be moved into place")
    except BaseException:
        system.delete(from_place, True)
        raise
    return name


def batches(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """The rows of all batches at ``path``, with those columns of ``schema`` alone; none if there is no table yet."""
    place, system = hadoop_path(spark, path)
    found = system.exists(place) and any(s.getPath().getName().startswith("batch=") for s in system.listStatus(place))
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(schema).format(kind).load(path)
