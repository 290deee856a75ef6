"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize, one_space, text_or_empty

PREFIX_CHARS = 256


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("__id"), one_space(text_or_empty(text_col)).alias("__text")).withColumn("__n", F.length("__text"))


def _prefix(text: Column) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX_CHARS))


def _survivors(rows: DataFrame) -> DataFrame:
    """``__n, __p``: lengths and prefix hashes that two rows or more have, as a written table.

    The text is read once, into a narrow table of two numbers a row; lengths that one row alone has are
    out before prefixes are grouped.
    """
    marks = materialize(rows.select("__n", _prefix(F.col("__text")).alias("__p")), "marks")
    more = F.count(F.lit(1)) > 1
    lengths = materialize(marks.groupBy("__n").agg(more.alias("__more")).filter("__more").select("__n"), "lengths")
    return materialize(marks.join(lengths, "__n", "left_semi").groupBy("__n", "__p").agg(more.alias("__more")).filter("__more").select("__n", "__p"), "prefixes")


def _groups(hashed: DataFrame) -> DataFrame:
    """``sha256, keep_id, group_size`` of the groups of two or more, from rows ``__id, sha256``."""
    return hashed.groupBy("sha256").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """One row per text that at least two rows share: ``sha256, keep_id, group_size``.

    Each step groups the survivors of the step before by a finer key and keeps groups of two rows or
    more: length of the text, then a hash of its first characters, then SHA-256 of all of it. A
    column that is cheaper to know decides first; the full text is hashed for rows that still have a
    partner (where their keys fit ``broadcast_rows``; beyond, digests and never texts are joined).
    Counting is pre-aggregated before each shuffle, so a text that a third of all rows hold makes one
    row per task.

    Texts of any length are compared after each run of ASCII white space became one space; null counts
    as the empty text. ``keep_id`` is the smallest non-null id of the group, null if all ids are null.
    An empty table gives no rows. Other columns are not read.
    """
    rows = _keys(docs, id_col, text_col)
    prefixes = _survivors(rows)
    keyed = rows.withColumn("__p", _prefix(F.col("__text")))
    hinted = broadcast_within(prefixes, broadcast_rows)
    if hinted is not prefixes:
        return _groups(keyed.join(hinted, ["__n", "__p"], "left_semi").select("__id", F.sha2("__text", 256).alias("sha256")))
    return _groups(keyed.select("__id", "__n", "__p", F.sha2("__text", 256).alias("sha256")).join(prefixes, ["__n", "__p"], "left_semi"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``keep_id, group_size, kept, text_sha256``.

    ``kept`` is true for the row that stays; rows that repeat the id of the row that stays share its
    fate. A row without id stays only in a group without any id. Null counts as the empty text, texts of
    any length are read whole, and an empty table gives no rows. As every row's digest is asked for, the
    last step writes all of them and groups those of the survivors alone. Other columns of ``docs`` are
    neither read nor returned, so their names cannot clash.
    """
    rows = _keys(docs, id_col, text_col)
    prefixes = _survivors(rows)
    every = materialize(rows.select("__id", "__n", _prefix(F.col("__text")).alias("__p"), F.sha2("__text", 256).alias("sha256")), "digests")
    groups = materialize(_groups(every.join(broadcast_within(prefixes, 200_000), ["__n", "__p"], "left_semi")), "exact").withColumnRenamed("sha256", "__sha")
    out = every.join(groups, F.col("sha256") == F.col("__sha"), "left")
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("bigint"))
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(F.col("__id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` less every row whose text a row with a smaller id holds; all columns stay, whatever their names.

    The text itself is never shuffled while the groups of copies fit ``broadcast_rows``; beyond that
    the rows are joined by hash. Nulls, repeated ids and empty tables are as in ``exact_duplicates``.
    """
    groups = materialize(duplicate_groups(docs, id_col, text_col), "exact").select("sha256", F.struct("keep_id").alias("keep"))
    digest = F.sha2(one_space(text_or_empty(text_col)), 256)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest")).join(broadcast_within(groups, broadcast_rows), F.col("digest") == F.col("sha256"), "left")
    stays = F.col("keep").isNull() | F.col("row").getField(id_col).eqNullSafe(F.col("keep.keep_id"))
    return joined.filter(stays).select("row.*")


def op9_exact_dedup(spark, sf_dir):
    """Every document with the row that stays of its group."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
