"""Helpers shared by the corpus operators: written tables, bounded samples, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import broadcast_within, materialize, shared_dir

__all__ = ["SPACE", "ascii_lower", "broadcast_within", "drop_table", "labelled_sample", "materialize", "one_space", "shared_dir", "text_or_empty", "without_ids"]

#: ASCII white space; the same six characters as ``str.split`` uses on bytes.
SPACE = "[\\x20\\x09-\\x0D]+"


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split("://", 1)[-1] in folder:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without_ids(docs: DataFrame, losers: DataFrame, id_col: str, rows: int = 200_000) -> DataFrame:
    """``docs`` less the rows whose id is in ``losers`` (a written one-column table). Null ids stay."""
    keys = broadcast_within(losers.toDF("__loser"), rows)
    return docs.join(keys, docs[id_col] == keys["__loser"], "left_anti")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, characters: int) -> DataFrame:
    """``(label, text)`` of at most ``rows`` labelled rows of ``docs`` with at most ``characters`` characters in all.

    A written table that is bounded by both numbers, whatever the size of ``docs``: the labelled ids of
    least hash, and of their texts, in that order, those that end within ``characters``; texts of more than
    a 64th of that are not learned from. Rows with null labels or ids are left out, and repeated labels
    of an id count once (the largest).
    """
    known = labels.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.groupBy("__key").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("__id") == F.col("__key")).select("__id", "label", "text", F.length("text").alias("__n"))
    found = materialize(joined.filter(F.col("__n") <= characters // 64), "labelled")
    order = Window.orderBy(F.xxhash64("__id"), "__id", "__n")  # of at most `rows` ids
    if found.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first().n > characters:
        ends = found.select("__id", "__n").withColumn("__end", F.sum("__n").over(order)).filter(F.col("__end") <= characters)
        found = found.join(F.broadcast(ends.select("__id").distinct()), "__id", "left_semi")
    return found.select("label", "text")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; ends are not trimmed."""
    return F.regexp_replace(text, SPACE, " ")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
