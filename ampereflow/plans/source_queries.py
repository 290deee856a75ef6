"""Registered queries of the sources: files written from the tables and read back, headers, zones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast
from ..series import LOAD
from ..shared import shared_dir
from ..sources import constraints, csv_records, header_join, versions
from .fixtures import LOAD_SQL, load_hourly, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Documents of one written file, the place in it that is broken, and the most characters of a cell.
FILE_ROWS, BROKEN_ROW, LONGEST = 250, 200, 1 << 30


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(text, F.lit("")), '"', '""'), F.lit('"'))


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query("csv_records", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, CAST(5 AS INTEGER) AS cells FROM documents")
def whole_csv(spark, d):
    """All documents written as CSV with quoted cells, line breaks and all, and read back."""
    docs = table(spark, d, "documents")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(F.col("text")), "lang", _quoted(F.col("source")), F.lit('""'))
    path = _folder(spark, "csv")
    docs.select(line).write.text(path)
    cells = F.col("cells")
    rows = csv_records.read_records(spark, path, cell_limit=LONGEST).rows
    return rows.select(cells[0].cast("bigint").alias("doc_id"), F.sha2(cells[1], 256).alias("text_sha256"), cells[2].alias("lang"), F.size(cells).alias("cells"))


_BROKEN_SQL = f"""
WITH rows AS (SELECT doc_id, doc_id // {FILE_ROWS} AS file, doc_id % {FILE_ROWS} = {BROKEN_ROW} AS bad FROM documents),
ends AS (SELECT file, min(doc_id) FILTER (WHERE bad) AS stop FROM rows GROUP BY file)
SELECT file, count(*) FILTER (WHERE stop IS NULL OR doc_id < stop) AS kept, max(doc_id) FILTER (WHERE stop IS NULL OR doc_id < stop) AS last_kept,
    CASE WHEN any_value(stop) IS NULL THEN NULL WHEN file % 3 = 0 THEN 'csv_decode_failed' ELSE 'csv_parse_failed' END AS code,
    CASE WHEN any_value(stop) IS NOT NULL THEN count(*) FILTER (WHERE doc_id < stop) + 1 END AS pos
FROM rows JOIN ends USING (file) GROUP BY file"""


@query("csv_broken", _BROKEN_SQL)
def broken_csv(spark, d):
    """Documents in files of 250, of which one each has a byte that is no UTF-8, text behind a closing quote, or a quote that is never closed."""
    docs = table(spark, d, "documents").withColumn("file", F.floor(F.col("doc_id") / FILE_ROWS))
    text = _quoted(F.col("text"))
    fault = F.pmod("file", F.lit(3))
    bad = F.when(fault == 0, F.concat(F.lit('"'), F.unhex(F.lit("C3")).cast("string"), text)).when(fault == 1, F.concat(text, F.lit("x"))).otherwise(F.concat(text, F.lit(',"open')))
    shown = F.when(F.col("doc_id") % FILE_ROWS == BROKEN_ROW, bad).otherwise(text)
    path = _folder(spark, "broken")
    rows = docs.repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("file", F.concat_ws(",", F.col("doc_id").cast("string"), shown).alias("line")).write.partitionBy("file").text(path)
    # Folders named by a partition are files of their own here, not a column.
    found = csv_records.read_records(spark, f"{path}/file=*", cell_limit=LONGEST)
    number = lambda c: F.regexp_extract(c, r"/file=(\d+)/", 1).cast("bigint")
    kept = found.rows.groupBy(number(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("kept"), F.max(F.col("cells")[0].cast("bigint")).alias("last_kept"))
    errors = found.errors.select(number(F.col("file")).alias("__file"), "code", "pos")
    return kept.join(errors, F.col("file") == F.col("__file"), "left").drop("__file")


_KEY_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
#: The longest block that both texts have, the first in either if there are several.
_BLOCK_SQL = (
    "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: "
    "{'k': len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: substr(a, i, k) = substr(b, j, k))), 'i': -i, 'j': -j}))))"
)
_HEADER_SQL = f"""
WITH RECURSIVE headers AS (
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN substr(n_name, 1, p - 1) || substr(n_name, p + 1) WHEN 1 THEN replace(n_name, ' ', '__') || ' ' ELSE substr(n_name, 1, p) || 'x' || substr(n_name, p + 1) END AS header
    FROM (SELECT s_suppkey, n_name, CAST(s_suppkey // 3 % length(n_name) + 1 AS INTEGER) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey)
), keyed AS (SELECT s_suppkey, {_KEY_SQL.format("header")} AS key FROM headers), names AS (SELECT n_name AS field, {_KEY_SQL.format("n_name")} AS name FROM nation),
segments AS (
    SELECT key, name, key AS a, name AS b, 0 AS depth FROM (SELECT DISTINCT key FROM keyed) CROSS JOIN names
    UNION ALL
    SELECT key, name, piece[1] AS a, piece[2] AS b, depth + 1 FROM (
        SELECT key, name, depth, unnest([[substr(a, 1, CAST(-block.i - 1 AS INTEGER)), substr(b, 1, CAST(-block.j - 1 AS INTEGER))], [substr(a, CAST(-block.i + block.k AS INTEGER)), substr(b, CAST(-block.j + block.k AS INTEGER))]]) AS piece
        FROM (SELECT *, {_BLOCK_SQL} AS block FROM segments WHERE length(a) > 0 AND length(b) > 0) WHERE block.k > 0)
    WHERE length(piece[1]) > 0 AND length(piece[2]) > 0
), scored AS (
    SELECT key, field, 2.0::DOUBLE * sum(({_BLOCK_SQL}).k) / any_value(length(key) + length(segments.name)) AS ratio FROM segments JOIN names ON segments.name = names.name GROUP BY key, field
), ranked AS (SELECT key, field, ratio, row_number() OVER (PARTITION BY key ORDER BY ratio DESC, field) AS r, lead(ratio) OVER (PARTITION BY key ORDER BY ratio DESC, field) AS next FROM scored WHERE ratio >= 0.85),
answers AS (SELECT keyed.s_suppkey, CASE WHEN names.field IS NOT NULL THEN 'exact' WHEN ratio IS NULL THEN 'unresolved' WHEN ratio - next < 0.05 THEN 'ambiguous' ELSE 'fuzzy' END AS status, names.field AS exact, ranked.field AS fuzzy, ratio
    FROM keyed LEFT JOIN names ON key = name LEFT JOIN ranked ON keyed.key = ranked.key AND r = 1)
SELECT s_suppkey, status, CASE status WHEN 'exact' THEN exact WHEN 'fuzzy' THEN fuzzy END AS field, round(CASE WHEN status = 'exact' THEN 1.0 ELSE coalesce(ratio, 0.0) END, 9) AS confidence FROM answers"""


@query("header_resolve", _HEADER_SQL)
def header_resolve(spark, d):
    """Nations' names with a character less, one more, or other separators, one for each supplier, resolved to nations."""
    nation = table(spark, d, "nation")
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    place = (F.floor(F.col("s_suppkey") / 3) % F.length("n_name") + 1).cast("int")
    part = lambda start, length=None: F.substr("n_name", start, length) if length is not None else F.substr("n_name", start)
    less, more = F.concat(part(F.lit(1), place - 1), part(place + 1)), F.concat(part(F.lit(1), place), F.lit("x"), part(place + 1))
    case = F.col("s_suppkey") % 3
    header = F.when(case == 0, less).when(case == 1, F.concat(F.replace("n_name", F.lit(" "), F.lit("__")), F.lit(" "))).otherwise(more)
    names = nation.select(F.col("n_name").alias("field"), F.col("n_name").alias("name"))
    found = header_join.resolve(suppliers.select("s_suppkey", header.alias("header")), names)
    return found.select("s_suppkey", "status", "field", F.round("confidence", 9).alias("confidence"))


@query(
    "constraint_records",
    """SELECT s_suppkey AS request_id, CASE k WHEN 0 THEN 'refusal' WHEN 1 THEN 'envelope' WHEN 2 THEN 'evidence' WHEN 3 THEN 'record' WHEN 4 THEN 'evidence' END AS failure, CASE WHEN k < 5 THEN 0 ELSE 2 END AS records, CASE WHEN k >= 5 THEN round(s_acctbal, 2) END AS least, CASE WHEN k >= 5 THEN CAST(DATE '2026-01-01' + CAST(s_nationkey AS INTEGER) AS VARCHAR) END AS since
    FROM (SELECT *, s_suppkey % 7 AS k FROM supplier)""",
)
def typed_constraints(spark, d):
    """Answers made of suppliers, of which five in seven are refusals, of another form, without evidence, or break a rule."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), (F.col("s_suppkey") % 7).alias("k"), F.round("s_acctbal", 2).alias("least"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("s_nationkey").cast("int")).cast("string").alias("since"), F.trim("s_name").alias("name"))
    k = F.col("k")

    def candidate(name: str, cited: Column, end: Column):
        fields = [F.concat(F.lit(name), "name").alias("constraint_id"), F.when((k == 1) & (name == "b"), F.lit(None)).otherwise(F.lit("cap")).alias("constraint_type"), F.lit(" a cap ").alias("description"), F.col("since").alias("effective_from"), end.alias("effective_to"), F.col("least").alias("minimum_value"), F.lit("AMD").alias("currency"), F.array(cited).alias("evidence_chunk_ids")]
        return F.struct(*fields)

    first = candidate("a", F.when(k == 2, "c9").otherwise("c1"), F.when(k == 3, "2020-01-01").otherwise(F.col("since")))
    second = candidate("b", F.when(k == 4, "elsewhere").otherwise("c2"), F.when(k == 4, "2020-01-01"))
    answers = rows.select("request_id", F.when(k == 0, "no").alias("refusal"), F.to_json(F.struct(F.array(first, second).alias("constraints"))).alias("answer"))
    chunks = rows.select("request_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("chunk_id"))
    found = constraints.constraint_records(answers, chunks)
    counts = found.records.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("records"), F.min("minimum_value").alias("least"), F.min("effective_from").cast("string").alias("since"))
    out = rows.select("request_id").join(found.failures, "request_id", "left").join(counts, "request_id", "left")
    return out.select("request_id", "failure", F.coalesce("records", F.lit(0)).alias("records"), "least", "since")


@query(
    "request_check",
    """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN 'empty_id' WHEN c_custkey % 11 = 1 THEN 'empty_id' WHEN c_custkey % 11 IN (2, 3) THEN 'not_utc' WHEN c_custkey % 11 = 4 THEN 'no_target' WHEN strange THEN 'other_history' END AS verdict
    FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderkey % 3 = 0) AS strange FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def request_check(spark, d):
    """One request for each customer, with its orders as history, some of it another's."""
    k = F.col("c_custkey") % 11
    customers = table(spark, d, "customer")
    name = F.col("c_custkey").cast("string")
    requests = customers.select(F.col("c_custkey").alias("request_id"), F.when(k == 0, "  ").otherwise("run").alias("run_id"), F.when(k == 1, F.lit(None)).otherwise(name).alias("consumer_id"), F.when(k == 2, "2026-01-01T00:00:00").when(k == 3, "2026-01-01T00:00:00+01:00").when(k == 5, "2026-01-01T00:00:00+00:00").otherwise("2026-01-01T00:00:00Z").alias("generated_at"), F.when(k == 4, F.array().cast("array<timestamp_ntz>")).otherwise(F.array(F.lit("2026-01-02 00:00:00").cast("timestamp_ntz"))).alias("targets"))
    history = table(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("o_custkey").cast("string")).alias("consumer_id"))
    return forecast.judge_requests(requests, history, LOAD)


@query(
    "table_versions",
    f"""SELECT 'up' AS step, consumer_id, timestamp, round(value_mw, 6) AS value_mw, sha256(consumer_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')) AS record_key FROM {LOAD_SQL}
    UNION ALL SELECT 'down', consumer_id, timestamp, round(value_mw, 6), NULL FROM {LOAD_SQL}""",
)
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Hourly loads as a table of the first version, brought up to the second, and another one brought up and back."""
    shown = []
    for step, targets in (("up", (2,)), ("down", (2, 1))):
        path = _folder(spark, "versions")
        versions.create(load_hourly(spark, d).withColumn("day", F.to_date("timestamp")), path, 1, "day")
        for target in targets:
            versions.migrate(spark, path, versions.OBSERVATIONS, target, "day")
        rows = versions.read(spark, path)
        key = F.col("record_key") if "record_key" in rows.columns else F.lit(None).cast("string")
        shown.append(rows.select(F.lit(step).alias("step"), "consumer_id", "timestamp", F.round("value_mw", 6).alias("value_mw"), key.alias("record_key")))
    return shown[0].unionByName(shown[1])
