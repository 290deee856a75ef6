"""Headers of any number of files resolved at once: a similarity join of header names to the names of fields.

The same rules as :class:`headers.Resolver`, over tables. Each different header is looked up once. One that equals no
name meets, by pairs of neighbouring characters, only names that can reach the least similarity. With keys of
``L`` characters together, of which the ratio asks ``M`` matched ones on each side, blocks of matches are parted by
unmatched characters, so there are at most ``L - 2M + 1``, and a block of ``k`` characters has ``k - 1`` pairs: at least
``3M - L - 1`` pairs are shared. Only pairs of keys with that count are compared block by block.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequestError
from ..shared import broadcast_within, materialize
from .headers import ACCEPT, ENERGY_WORDS, LEAD, POWER_WORDS, Field, normalize_name


def _keys(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else normalize_name(n) for n in names.to_pylist()], pa.string())


def _ratios(ones: pa.Array, others: pa.Array) -> pa.Array:
    matcher, out, last = SequenceMatcher(autojunk=False), [], None
    for one, other in zip(ones.to_pylist(), others.to_pylist()):
        if other != last:  # what the matcher knows of its second text is used again
            matcher.set_seq2(other)
            last = other
        matcher.set_seq1(one)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def key_of(name: Column) -> Column:
    """The normalised form of a header."""
    return F.arrow_udf(_keys, T.StringType())(name)


def field_names(spark: SparkSession, fields: tuple[Field, ...]) -> DataFrame:
    """``(field, name, required)`` of a configuration."""
    return spark.createDataFrame([(f.name, n, f.required) for f in fields for n in (f.name, *f.aliases)], "field string, name string, required boolean")


def checked_names(names: DataFrame) -> DataFrame:
    """``(key, field)`` of the names of fields; an empty name and one that belongs to two fields are refused."""
    keyed = materialize(names.select("field", key_of(F.col("name")).alias("key")), "names")
    wrong = keyed.groupBy("key").agg(F.count_distinct("field").alias("n")).filter((F.col("n") > 1) | (F.coalesce("key", F.lit("")) == ""))
    if wrong.limit(1).count() or not keyed.limit(1).count():
        raise InvalidRequestError("a header name is empty or belongs to two fields")
    return keyed.select("key", "field").distinct()


def _pairs(keys: DataFrame) -> DataFrame:
    """``(key, gram, nth)``: each pair of neighbouring characters of a key, told apart where it repeats."""
    places = F.sequence(F.lit(1), F.length("key") - 1)
    grams = keys.filter(F.length("key") > 1).select("key", F.explode(F.transform(places, lambda i: F.col("key").substr(i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy("key", "gram").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select("key", "gram", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


def candidates(keys: DataFrame, names: DataFrame, accept: float = ACCEPT, broadcast_rows: int = 200_000) -> DataFrame:
    """``(key, name)`` of keys and names that share as many pairs of characters as a similarity of ``accept`` asks."""
    grams = materialize(_pairs(names.select("key").distinct()).select(F.col("key").alias("name"), F.col("gram").alias("__gram"), F.col("nth").alias("__nth")), "grams")
    together = F.length("key") + F.length("name")
    matched = F.ceil(together * (accept / 2) - 1e-9)
    least = 3 * matched - together - 1
    # Neither key may have fewer characters than must match.
    fits = F.least(F.length("key"), F.length("name")) >= matched
    met = _pairs(keys).join(broadcast_within(grams, broadcast_rows), (F.col("gram") == F.col("__gram")) & (F.col("nth") == F.col("__nth")) & fits)
    shared = met.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    return shared.filter(F.col("n") >= least).select("key", "name")


def resolve(headers: DataFrame, names: DataFrame, accept: float = ACCEPT, lead: float = LEAD, broadcast_rows: int = 200_000) -> DataFrame:
    """``headers (header, ...)`` with ``status`` (exact, fuzzy, ambiguous or unresolved), ``field``, ``confidence`` and ``key``.

    ``names (field, name)`` are the fields' own names and aliases. Null and blank headers are unresolved; repeated
    headers have one answer. A fuzzy hit is the field of the best name, if its ratio of matching blocks is at least
    ``accept`` and leads the next field's by ``lead``; ties go by the field's name.
    """
    known = materialize(checked_names(names), "known")
    keyed = materialize(headers.select("header").distinct().select("header", key_of(F.col("header")).alias("key")), "headers")
    keys = keyed.filter(F.coalesce("key", F.lit("")) != "").select("key").distinct()
    exact = known.select(F.col("key").alias("__key"), F.col("field").alias("exact"))
    settled = materialize(keys.join(broadcast_within(exact, broadcast_rows), F.col("key") == F.col("__key"), "left").select("key", "exact"), "settled")
    open_keys = settled.filter("exact is null").select("key")
    near = candidates(open_keys, known, accept, broadcast_rows)
    scored = near.select("key", "name", F.arrow_udf(_ratios, T.DoubleType())("key", "name").alias("ratio")).filter(F.col("ratio") >= accept)
    named = known.select(F.col("key").alias("__name"), "field")
    fields = scored.join(broadcast_within(named, broadcast_rows), F.col("name") == F.col("__name")).groupBy("key", "field").agg(F.max("ratio").alias("ratio"))
    fields = materialize(fields, "scored")
    best = fields.groupBy("key").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "field")).alias("best"))
    others = fields.join(best.select(F.col("key").alias("__best"), F.col("best.field").alias("__field")), (F.col("key") == F.col("__best")) & (F.col("field") != F.col("__field"))).groupBy(F.col("key").alias("__other")).agg(F.max("ratio").alias("next"))
    ranked = best.join(others, F.col("key") == F.col("__other"), "left").select(F.col("key").alias("__fuzzy"), F.col("best.field").alias("fuzzy"), (-F.col("best.less")).alias("ratio"), "next")
    joined = settled.join(ranked, F.col("key") == F.col("__fuzzy"), "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("ratio").isNull(), "unresolved").when(F.col("ratio") - F.col("next") < lead, "ambiguous").otherwise("fuzzy")
    field = F.when(F.col("status") == "exact", F.col("exact")).when(F.col("status") == "fuzzy", F.col("fuzzy"))
    confidence = F.when(F.col("status") == "exact", 1.0).otherwise(F.coalesce("ratio", F.lit(0.0)))
    answers = joined.withColumn("status", status).select(F.col("key").alias("__answer"), "status", field.alias("field"), confidence.alias("confidence"))
    answered = keyed.join(answers, F.col("key") == F.col("__answer"), "left").select(F.col("header").alias("__header"), "key", F.coalesce("status", F.lit("unresolved")).alias("status"), "field", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    answered = materialize(answered, "answered")
    return headers.join(broadcast_within(answered, broadcast_rows), F.col("header").eqNullSafe(F.col("__header"))).drop("__header")


def safe_units(matches: DataFrame, unit: str) -> DataFrame:
    """``matches`` less the hits for ``value_mw`` whose header doesn't state the configured power unit safely (as :func:`headers.safe_units`)."""
    words = F.split("key", " ")
    last = F.element_at(words, -1)
    other = F.when(F.col("status") == "fuzzy", last != unit.lower()).otherwise(last.isin(*POWER_WORDS) & (last != unit.lower()))
    energy = last.isin(*ENERGY_WORDS) | F.col("key").rlike("(^| )mw h$")
    withdrawn = F.coalesce((F.col("field") == "value_mw") & (other | energy), F.lit(False))
    return matches.withColumns({"status": F.when(withdrawn, "unresolved").otherwise(F.col("status")), "field": F.when(~withdrawn, F.col("field")), "confidence": F.when(withdrawn, 0.0).otherwise(F.col("confidence"))})


def settle(matches: DataFrame, names: DataFrame, file: str = "file") -> DataFrame:
    """``(file, missing, collisions, ambiguous, usable)`` by file, from matches with a column ``file`` and the fields' ``names``.

    ``missing`` are the required fields without a header, ``collisions`` those with several, both sorted; ``ambiguous``
    counts headers. A file is usable if it has none of the three.
    """
    hits = matches.filter(F.col("field").isNotNull()).groupBy(file, "field").agg(F.count(F.lit(1)).alias("n"))
    by_file = hits.groupBy(file).agg(F.collect_set("field").alias("found"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("field")))).alias("collisions"))
    required = names.filter("required").agg(F.sort_array(F.collect_set("field")).alias("required"))
    doubtful = matches.groupBy(F.col(file).alias("__file")).agg(F.sum((F.col("status") == "ambiguous").cast("bigint")).alias("ambiguous"))
    nothing = F.array().cast("array<string>")
    joined = doubtful.join(by_file, F.col("__file") == F.col(file), "left").crossJoin(F.broadcast(required))  # one row of the configuration
    missing = F.array_except("required", F.coalesce("found", nothing))
    out = joined.select(F.col("__file").alias(file), missing.alias("missing"), F.coalesce("collisions", nothing).alias("collisions"), "ambiguous")
    return out.withColumn("usable", (F.size("missing") == 0) & (F.size("collisions") == 0) & (F.col("ambiguous") == 0))
