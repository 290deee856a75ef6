"""Typed constraint records, and requests judged as a table."""

import json
from datetime import date, datetime

import pytest

from ampereflow.errors import DependencyUnavailableError, InvalidRequestError
from ampereflow.operators import forecast
from ampereflow.series import LOAD, PRICE
from ampereflow.sources import constraints

GOOD = {"constraint_id": " c-1 ", "constraint_type": "cap", "description": "a cap", "effective_from": "2026-01-01", "evidence_chunk_ids": ["k1"]}
FULL = GOOD | {"effective_to": "2026-02-01", "minimum_value": 1, "maximum_value": 2.5, "unit": "MW", "currency": "AMD", "source_document_id": "d"}
CASES = [
    ([GOOD], None), ([FULL, GOOD], None), ([], None), ([GOOD | {"unit": None, "effective_to": None}], None),
    ([GOOD | {"more": 1}], "envelope"), ([{k: v for k, v in GOOD.items() if k != "description"}], "envelope"), ([GOOD | {"description": 5}], "envelope"), ([GOOD | {"effective_from": "2026-02-30"}], "envelope"),
    ([GOOD | {"effective_from": "01.02.2026"}], "envelope"), ([GOOD | {"effective_to": 7}], "envelope"), ([GOOD | {"minimum_value": "x"}], "envelope"), ([GOOD | {"evidence_chunk_ids": []}], "envelope"), ([GOOD | {"evidence_chunk_ids": ["k1", " "]}], "envelope"),
    ([GOOD | {"evidence_chunk_ids": "k1"}], "envelope"), ([GOOD | {"evidence_chunk_ids": [1]}], "envelope"), ([GOOD, "text"], "envelope"), ([GOOD, 3], "envelope"), ([GOOD | {"maximum_value": True}], "envelope"),
    ([GOOD | {"evidence_chunk_ids": ["k1", "k9"]}], "evidence"), ([GOOD | {"evidence_chunk_ids": ["k9"], "constraint_id": " "}], "evidence"), ([GOOD | {"constraint_id": " "}, GOOD | {"evidence_chunk_ids": ["k9"]}], "record"),
    ([GOOD | {"evidence_chunk_ids": ["k9"]}, GOOD | {"more": 1}], "envelope"), ([GOOD | {"unit": ""}], "record"), ([GOOD | {"currency": "amd"}], "record"), ([FULL | {"effective_to": "2025-01-01"}], "record"), ([FULL | {"maximum_value": 0}], "record"),
]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_answers_hold_or_fail_whole(spark, broadcast_rows):
    rows = [(i, None, json.dumps({"constraints": c})) for i, (c, _) in enumerate(CASES)]
    odd = [(100, "no", None), (101, None, None), (102, None, "{"), (103, None, "[]"), (104, None, '{"constraints": {}}'), (105, None, json.dumps({"constraints": [GOOD], "more": 1})), (106, "no", json.dumps({"constraints": [GOOD]})), (107, None, json.dumps({"constraints": [GOOD]}))]
    answers = spark.createDataFrame(rows + odd, "request_id int, refusal string, answer string")
    chunks = spark.createDataFrame([(i, "k1") for i in range(107)] + [(107, "k2"), (0, "k9")], "request_id int, chunk_id string")
    found = constraints.constraint_records(answers, chunks, broadcast_rows)
    want = {i: f for i, (_, f) in enumerate(CASES) if f} | {100: "refusal", 101: "envelope", 102: "envelope", 103: "envelope", 104: "envelope", 105: "envelope", 106: "refusal", 107: "evidence"}
    assert {r.request_id: r.failure for r in found.failures.collect()} == want
    records = {(r.request_id, r.position): r for r in found.records.collect()}
    assert sorted(records) == [(i, p) for i, (c, f) in enumerate(CASES) if not f for p in range(len(c))]
    one = records[1, 0]
    assert (records[0, 0].constraint_id, one.effective_from, one.effective_to, one.minimum_value, one.maximum_value, one.unit, one.evidence_chunk_ids) == ("c-1", date(2026, 1, 1), date(2026, 2, 1), 1.0, 2.5, "MW", ["k1"])
    with pytest.raises(DependencyUnavailableError):
        constraints.require_constraints(found)


def test_no_answers(spark):
    found = constraints.constraint_records(spark.createDataFrame([], "request_id int, refusal string, answer string"), spark.createDataFrame([], "request_id int, chunk_id string"))
    assert constraints.require_constraints(found).count() == 0


def judged_alone(spark, request, history):
    try:
        targets = spark.createDataFrame([(t,) for t in request["targets"]], "timestamp timestamp")
        rows = spark.createDataFrame(history or [], "market_id string, currency string")
        made = datetime.fromisoformat(request["generated_at"])
        forecast.check_request(rows, targets, PRICE, {"market_id": request["market_id"], "currency": request["currency"]}, request["run_id"], made)
    except InvalidRequestError as error:
        return {"an id is empty": "empty_id", "the generation time is not in UTC": "not_utc", "no target was requested": "no_target", "the history belongs to another entity": "other_history"}[str(error)]
    return None


def test_requests_as_a_table_equal_single_checks(spark):
    now, t = "2026-01-01T00:00:00+00:00", [datetime(2026, 1, 2)]
    base = {"run_id": "r", "market_id": "m", "currency": "AMD", "generated_at": now, "targets": t}
    changes = [{}, {"run_id": " "}, {"run_id": None}, {"market_id": ""}, {"currency": None}, {"generated_at": "2026-01-01T00:00:00"}, {"generated_at": "2026-01-01T04:00:00+04:00"}, {"generated_at": "2026-01-01T00:00:00Z"}, {"targets": []}, {"targets": [], "run_id": ""}, {"targets": t * 3}]
    cases = [(base | c, h) for c in changes for h in ([], [("m", "AMD")] * 3, [("m", "AMD"), ("m", "EUR")], [("x", "AMD")])]
    rows = [(i, r["run_id"], r["market_id"], r["currency"], r["generated_at"], r["targets"]) for i, (r, _) in enumerate(cases)]
    requests = spark.createDataFrame(rows, "request_id int, run_id string, market_id string, currency string, generated_at string, targets array<timestamp>")
    history = spark.createDataFrame([(i, *h) for i, (_, hs) in enumerate(cases) for h in hs], "request_id int, market_id string, currency string")
    got = {r.request_id: r.verdict for r in forecast.judge_requests(requests, history, PRICE).collect()}
    assert len(got) == len(cases)
    for i, (r, h) in list(enumerate(cases))[::3]:
        assert got[i] == judged_alone(spark, r, h), (r, h)
    odd = spark.createDataFrame([(1, "r", "c", "no instant", t), (2, "r", "c", None, t), (3, "r", "c", "2026-01-01", t), (4, "r", "c", now, None)], "request_id int, run_id string, consumer_id string, generated_at string, targets array<timestamp>")
    empty = spark.createDataFrame([], "request_id int, consumer_id string")
    assert {r.request_id: r.verdict for r in forecast.judge_requests(odd, empty, LOAD).collect()} == {1: "not_utc", 2: "not_utc", 3: "not_utc", 4: "no_target"}
