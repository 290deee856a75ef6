"""Headers of many files by join, against the resolver of one file."""

import random

import pytest
from pyspark.sql import functions as F

from ampereflow.errors import InvalidRequestError
from ampereflow.sources import header_join
from ampereflow.sources.headers import Field, Resolver, consumption_fields, safe_units

FIELDS = (
    Field("consumer_id", ("Customer number", "client")), Field("timestamp", ("reading time", "Zeitstempel")), Field("value_mw", ("Consumption_MW", "load")),
    Field("region_code_1", ("area_code_1",), False), Field("region_code_2", ("area_code_2",), False), Field("straße", ("ulica", "улица"), False),
)


def mutated(rng, text):
    text = list(text)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        at = rng.randrange(len(text) + 1)
        kind = rng.random()
        if kind < 0.4 and text:
            text.pop(min(at, len(text) - 1))
        elif kind < 0.8:
            text.insert(at, rng.choice("abcdeimnorstu_ 1wM"))
        elif len(text) > 1:
            at = rng.randrange(len(text) - 1)
            text[at], text[at + 1] = text[at + 1], text[at]
    return "".join(text) if rng.random() < 0.7 else "".join(text).upper()


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_equals_the_resolver_on_thousands_of_headers(spark, broadcast_rows):
    rng = random.Random(5)
    names = [n for f in FIELDS for n in (f.name, *f.aliases)]
    texts = [mutated(rng, rng.choice(names)) for _ in range(3000)] + ["", " ", "_", "a", "aa", "aaaaaaaaaaaaaaaaaaaa", "region_code_", "STRASSE", "Straße", None]
    headers = spark.createDataFrame([(i % 400, i, t) for i, t in enumerate(texts)], "file int, at int, header string")
    got = header_join.resolve(headers, header_join.field_names(spark, FIELDS), broadcast_rows=broadcast_rows)
    resolver = Resolver(FIELDS)
    want = {t: resolver.match(t) for t in set(texts) - {None}}
    statuses = {}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.header is None:
            assert r.status == "unresolved" and r.field is None
            continue
        match = want[r.header]
        assert (r.status, r.field, round(r.confidence, 12)) == (match.status, match.field, round(match.confidence, 12)), r.header
        statuses[r.status] = statuses.get(r.status, 0) + 1
    assert min(statuses[s] for s in ("exact", "fuzzy", "ambiguous", "unresolved")) > 5


def test_files_settle_like_the_resolver(spark):
    rng = random.Random(6)
    files = {}
    for f in range(120):
        headers = [mutated(rng, rng.choice(["consumer_id", "timestamp", "Consumption_MW", "value_mw", "Consumption_kW", "Consumption MWh", "load mw h", "note"])) for _ in range(rng.randint(1, 6))]
        files[f] = headers if rng.random() < 0.6 else ["consumer_id", "timestamp", "value_mw", *headers[:1]]
    rows = [(f, i, h) for f, hs in files.items() for i, h in enumerate(hs)]
    for unit in ("MW", "kW"):
        fields = consumption_fields(unit)
        names = header_join.field_names(spark, fields)
        matches = header_join.safe_units(header_join.resolve(spark.createDataFrame(rows, "file int, at int, header string"), names), unit)
        got = {r.file: r for r in header_join.settle(matches, names).collect()}
        resolver, usable = Resolver(fields), 0
        for f, headers in files.items():
            want = safe_units(resolver, resolver.resolve(headers), unit)
            assert (sorted(want.missing), list(want.collisions), want.usable) == (got[f].missing, got[f].collisions, got[f].usable), headers
            usable += want.usable
        assert unit == "kW" or usable


def test_candidates_are_few_and_complete(spark):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    keys = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(300)})
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    near = {(r.key, r.name) for r in header_join.candidates(frame, frame.withColumn("field", F.col("key"))).collect()}
    for a in keys:
        for b in keys:
            if SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85 and len(a) + len(b) > 3:
                assert (a, b) in near
    assert len(near) < len(keys) ** 2 / 10


def test_wrong_configurations_are_refused(spark):
    for rows in ([], [("a", " ")], [("a", "x"), ("b", "X")]):
        names = spark.createDataFrame(rows, "field string, name string")
        with pytest.raises(InvalidRequestError):
            header_join.checked_names(names)
