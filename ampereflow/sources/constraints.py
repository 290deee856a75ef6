"""A model's answers about regulatory constraints as canonical records: many answers at once, each taken whole or refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DependencyUnavailableError
from ..schemas import constraint_holds, currency_code, non_empty, stripped
from ..shared import broadcast_within, materialize

#: The fields of a candidate.
TEXTS = ("constraint_id", "constraint_type", "description")
OPTIONAL_TEXTS = ("unit", "currency", "source_document_id")
NUMBERS = ("minimum_value", "maximum_value")
DATES = ("effective_from", "effective_to")
EVIDENCE = "evidence_chunk_ids"
FIELDS = (*TEXTS, *OPTIONAL_TEXTS, *NUMBERS, *DATES, EVIDENCE)
#: Why an answer is refused, in the order in which it is judged.
REFUSAL, ENVELOPE, UNKNOWN, RECORD = "refusal", "envelope", "evidence", "record"


@dataclass(frozen=True)
class Constraints:
    """``records`` (request, position and the record's fields) of the answers that hold, ``failures (request_id, failure)`` of the others."""

    records: DataFrame
    failures: DataFrame


def _kind(tree: Column, path: str) -> Column:
    """The type of what a JSON tree holds at ``path``; null where it holds nothing."""
    return F.schema_of_variant(F.try_variant_get(tree, path, "variant"))


def candidates(answers: DataFrame) -> DataFrame:
    """``(request_id, position, typed, sound, <fields>)`` of each candidate of ``answers (request_id, answer)``, a JSON object of a list.

    ``typed`` says that all fields are known, the required ones there and each of its type; a date is a day in ISO form, a
    number finite, evidence a list of at least one text that isn't empty. Texts are stripped. An answer that is no such object
    has one row without position, whose ``typed`` is false; one without candidates has one whose ``typed`` is true.
    """
    tree = F.try_parse_json("answer")
    enclosed = F.coalesce((F.json_object_keys("answer") == F.array(F.lit("constraints"))) & _kind(tree, "$.constraints").startswith("ARRAY<"), F.lit(False))
    each = F.from_json("answer", "constraints array<string>")["constraints"]
    rows = answers.select("request_id", enclosed.alias("__enclosed"), F.posexplode_outer(F.when(enclosed, each)).alias("position", "__json"))
    rows = rows.withColumn("__tree", F.try_parse_json("__json"))
    node = F.col("__tree")
    kind = lambda name: F.coalesce(_kind(node, f"$.{name}"), F.lit("VOID"))
    text = lambda name: stripped(F.try_variant_get(node, f"$.{name}", "string"))
    day = lambda name: F.when(text(name).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text(name).try_cast("date"))
    number = lambda name: F.try_variant_get(node, f"$.{name}", "double")
    keys = F.json_object_keys("__json")
    typed = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) == 0, F.lit(False))
    for name in TEXTS:
        typed = typed & (kind(name) == "STRING")
    for name in OPTIONAL_TEXTS:
        typed = typed & kind(name).isin("STRING", "VOID")
    for name in NUMBERS:
        typed = typed & ((kind(name) == "VOID") | (kind(name).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$") & number(name).isNotNull() & (F.abs(number(name)) < float("inf"))))
    typed = typed & (kind(DATES[0]) == "STRING") & day(DATES[0]).isNotNull() & ((kind(DATES[1]) == "VOID") | ((kind(DATES[1]) == "STRING") & day(DATES[1]).isNotNull()))
    evidence = F.transform(F.try_variant_get(node, f"$.{EVIDENCE}", "array<string>"), stripped)
    typed = typed & (kind(EVIDENCE) == "ARRAY<STRING>") & F.coalesce((F.size(evidence) > 0) & F.forall(evidence, lambda e: e != ""), F.lit(False))
    values = {n: text(n) for n in (*TEXTS, *OPTIONAL_TEXTS)} | {n: number(n) for n in NUMBERS} | {n: day(n) for n in DATES} | {EVIDENCE: evidence}
    typed = F.when(F.col("position").isNull(), F.col("__enclosed")).otherwise(F.coalesce(typed, F.lit(False)))
    rows = rows.select("request_id", "position", typed.alias("typed"), *[v.alias(n) for n, v in values.items()])
    sound = constraint_holds(*[F.col(n) for n in (*DATES, *NUMBERS)])
    for name in TEXTS:
        sound = sound & non_empty(F.col(name))
    for name in ("unit", "source_document_id"):
        sound = sound & (F.col(name).isNull() | (F.col(name) != ""))
    return rows.withColumn("sound", sound & (F.col("currency").isNull() | currency_code(F.col("currency"))))


def constraint_records(answers: DataFrame, chunks: DataFrame, broadcast_rows: int = 200_000) -> Constraints:
    """Canonical records of ``answers (request_id, refusal, answer)``, whose evidence must be among the request's ``chunks (request_id, chunk_id)``.

    An answer fails as a whole, with the first reason that holds: ``refusal`` (the model refused), ``envelope`` (any candidate
    is not of the known form), then by candidate in their order ``evidence`` (a chunk that the request didn't have) and
    ``record`` (an empty text, a currency that is no code, an end before the start, a maximum below the minimum). A null answer is of no known form; a request without candidates
    has neither records nor a failure. Requests are told apart by an id that isn't null.
    """
    found = materialize(candidates(answers.filter("refusal is null")), "candidates")
    cited = found.filter("typed and position is not null").select("request_id", "position", F.explode(EVIDENCE).alias("chunk_id")).distinct()
    unknown = cited.join(chunks.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")
    place = lambda stage, at, reason: F.struct(F.lit(stage).alias("stage"), at.alias("at"), F.lit(reason).alias("reason")).alias("failure")
    # Evidence is judged before the record: twice the position leaves room for both.
    parts = [
        answers.filter("refusal is not null").select("request_id", place(0, F.lit(0), REFUSAL)),
        found.filter("not typed").select("request_id", place(1, F.lit(0), ENVELOPE)),
        unknown.select("request_id", place(2, 2 * F.col("position"), UNKNOWN)),
        found.filter("typed and position is not null and not sound").select("request_id", place(2, 2 * F.col("position") + 1, RECORD)),
    ]
    failed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    failed = materialize(failed.groupBy("request_id").agg(F.min("failure").alias("failure")).select("request_id", F.col("failure.reason").alias("failure")), "failures")
    good = found.filter("position is not null").join(broadcast_within(failed.select("request_id"), broadcast_rows), "request_id", "left_anti")
    return Constraints(good.drop("typed", "sound"), failed)


def require_constraints(found: Constraints) -> DataFrame:
    """The records, if no answer failed: one that did can't be trusted in part."""
    if found.failures.limit(1).count():
        raise DependencyUnavailableError("an answer can't be used")
    return found.records
