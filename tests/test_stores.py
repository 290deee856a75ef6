import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ampereflow.errors import ConflictError, DependencyUnavailableError, InvalidRequestError, NotFoundError
from ampereflow.functions import normalize
from ampereflow.operators import vectors
from ampereflow.plans import workflow
from ampereflow.sources import documents, store
from ampereflow import schemas

OBSERVATION = "consumer_id string, timestamp timestamp_ntz, value_mw double"
T0 = datetime(2026, 1, 1)


def observations(spark, *rows):
    return spark.createDataFrame([(c, T0.replace(hour=h), float(v)) for c, h, v in rows], OBSERVATION)


def test_save_is_idempotent_and_refuses_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = observations(spark, ("c", 0, 1), ("c", 1, 2), ("c", 1, 2))
    assert store.save(rows, path) == 2 and store.save(rows, path) == 0
    assert store.save(observations(spark, ("c", 1, 2), ("d", 1, 5)), path) == 1
    for bad in (observations(spark, ("e", 0, 1), ("c", 0, 9)), observations(spark, ("e", 0, 1), ("e", 0, 2))):
        with pytest.raises(ConflictError):
            store.save(bad, path)
    for bad in (observations(spark, (" ", 0, 1)), observations(spark, ("e", 0, -1)), observations(spark, ("e", 0, float("nan")))):
        with pytest.raises(InvalidRequestError):
            store.save(bad, path)
    assert spark.read.parquet(path).count() == 3


def test_writes_read_only_the_batch_from_the_store(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.createDataFrame([("c", datetime(2026, 1, d), float(d)) for d in range(1, 29)], OBSERVATION)
    assert store.save(days, path) == 28
    batch = spark.createDataFrame([("c", datetime(2026, 1, 3), 3.0), ("c", datetime(2026, 1, 4, 5), 1.0)], OBSERVATION)
    stored = store._days_of(spark.read.parquet(path), batch, "timestamp")
    assert len(stored.inputFiles()) == 28 and stored.count() == 2
    plan = store.upsert_actions(batch, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Aggregate")  # rows are dropped below the grouping
    assert store.save(batch, path) == 1


def test_both_ways_of_classifying_agree(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = lambda n: [(rng.choice(["a", "b", None]), rng.randrange(20), rng.choice([1.0, 2.0, None])) for _ in range(n)]
    schema = "k string, t int, v double"
    incoming, stored = spark.createDataFrame(rows(60), schema), spark.createDataFrame(rows(40), schema)
    found = []
    for share in (10**9, 0):
        monkeypatch.setattr(vectors, "WHOLE_TABLE", share)
        monkeypatch.setattr(vectors, "LARGE_CALL", 0)
        monkeypatch.setattr(vectors, "UNKNOWN", 1 << 80)
        found.append(sorted(map(str, vectors.classify(incoming, stored, ("k", "t"), "v").collect())))
    assert found[0] == found[1] and all(any(a in x for x in found[0]) for a in ("insert", "skip", "conflict"))


def test_a_failed_read_back_leaves_nothing(spark, tmp_path, monkeypatch):
    """A batch is seen whole or not at all, and a retry puts it in."""
    path = str(tmp_path / "t")
    assert store.save(observations(spark, ("c", 0, 1)), path) == 1
    rows = spark.createDataFrame([("c", datetime(2026, 1, d), float(d)) for d in range(2, 12)], OBSERVATION)

    def failing(*_):
        raise DependencyUnavailableError("a written row can't be read back")

    with monkeypatch.context() as patch:
        patch.setattr(store, "require_stored", failing)
        with pytest.raises(DependencyUnavailableError):
            store.save(rows, path)
    assert spark.read.parquet(path).count() == 1
    assert store.save(rows, path) == 10 and store.save(rows, path) == 0
    assert spark.read.parquet(path).count() == 11
    batches = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("batch=")]
    assert len(batches) == 2 and not list((tmp_path / "t" / "_staging").iterdir())


def test_a_batch_left_in_staging_is_not_read(spark, tmp_path):
    """A run that dies before the rename leaves a folder that no reader sees."""
    path = str(tmp_path / "t")
    store.save(observations(spark, ("c", 0, 1)), path)
    observations(spark, ("c", 0, 7), ("c", 2, 7)).withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(path + "/_staging/dead")
    assert store.save(observations(spark, ("c", 0, 1), ("c", 2, 3)), path) == 1
    assert sorted(r.value_mw for r in spark.read.parquet(path).collect()) == [1.0, 3.0]


def test_publish_fails_whole(spark, tmp_path):
    from ampereflow.shared import batches, publish

    path, rows = str(tmp_path / "p"), spark.range(10)
    seen = []
    publish(rows, path, lambda staged: seen.append(staged.count()))
    with pytest.raises(ZeroDivisionError):
        publish(rows, path, lambda staged: 1 // 0)
    assert seen == [10] and batches(spark, path, rows.schema).count() == 10
    assert batches(spark, str(tmp_path / "absent"), rows.schema).count() == 0


def test_dead_letters_are_read_by_prefix(spark, tmp_path, monkeypatch):
    import hashlib

    path = str(tmp_path / "dlq")
    schema = "record_id string, code string, adapter_name string"
    letters = spark.createDataFrame([(f"s:row:{i}", "x", "csv") for i in range(300)], schema)
    assert store.enqueue(letters, path) == 300
    small = letters.filter("record_id in ('s:row:4', 's:row:5')")
    prefixes = sorted({hashlib.sha256(f"s:row:{i}".encode()).hexdigest()[:2] for i in (4, 5)})
    stored = store.letters_of(spark, path, letters.schema, prefixes)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    want = sum(hashlib.sha256(f"s:row:{i}".encode()).hexdigest()[:2] in prefixes for i in range(300))
    assert stored.count() == want < 20
    asked = []
    real = store.letters_of
    monkeypatch.setattr(store, "letters_of", lambda s, p, k, prefixes=None: asked.append(prefixes) or real(s, p, k, prefixes))
    assert store.enqueue(small, path) == 0 and asked == [prefixes]
    with pytest.raises(ConflictError):
        store.enqueue(small.withColumn("code", F.lit("z")), path)
    assert store.enqueue(small.limit(0), path) == 0
    assert store.letters_of(spark, path, letters.schema).count() == 300


def test_payloads_are_decoded_or_refused(spark):
    import json

    space = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    good = {"document_id": "d", "chunk_id": "c", "ordinal": 0, "text": "t", "page_number": None, "content_sha256": "a" * 64}
    place = str(uuid.uuid5(space, '["d","c"]'))
    cases = [
        (place, good, None), (place.upper(), good | {"page_number": 3}, None), (place, good | {"more": 1}, "payload"), (place, {k: v for k, v in good.items() if k != "text"}, "payload"), (place, [1], "payload"),
        (place, good | {"ordinal": "0"}, "type"), (place, good | {"ordinal": -1}, "type"), (place, good | {"ordinal": True}, "type"), (place, good | {"ordinal": 1.5}, "type"), (place, good | {"page_number": 0}, "type"),
        (place, good | {"text": 5}, "type"), (place, good | {"text": " "}, "type"), (place, good | {"content_sha256": "A" * 64}, "digest"), (place, good | {"content_sha256": "a" * 63}, "digest"),
        (place, good | {"chunk_id": "e"}, "id"), ("x", good, "id"), (None, good, "id"),
    ]
    points = spark.createDataFrame([(i, json.dumps(p), n) for n, (i, p, _) in enumerate(cases)] + [(place, "{", 90), (place, None, 91)], "id string, payload string, n int")
    found = vectors.decode_payloads(points, space).collect()
    assert [r.problem for r in found] == [c for *_, c in cases] + ["payload", "payload"]
    assert (found[1].page_number, found[0].text, found[2].text) == (3, "t", None)
    assert vectors.require_decoded(points.filter("n < 2"), space).count() == 2
    with pytest.raises(DependencyUnavailableError):
        vectors.require_decoded(points, space)


def test_stream_of_batches_lands_once(spark, tmp_path):
    from ampereflow.streaming.upserts import save_stream

    observations(spark, ("c", 0, 1), ("c", 1, 2)).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feed = spark.readStream.schema(OBSERVATION).parquet(str(tmp_path / "in"))
        save_stream(feed, str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_dead_letters(spark, tmp_path):
    path = str(tmp_path / "dlq")
    letters = spark.createDataFrame([("s:row:2", "x", "csv"), ("s:row:3", "y", None)], "record_id string, code string, adapter_name string")
    assert store.enqueue(letters, path) == 2 and store.enqueue(letters, path) == 0
    with pytest.raises(ConflictError):
        store.enqueue(letters.withColumn("code", F.lit("z")), path)
    assert spark.read.schema(letters.schema).json(path).count() == 2


def test_cache():
    now = [0.0]
    cache = store.TtlCache(str.encode, bytes.decode, clock=lambda: now[0])
    cache.set(" k ", "v", 0.0001)
    assert cache.get("k") == "v"
    now[0] = 0.001
    assert cache.get("k") is None
    cache.set("k", "w", 5)
    cache.delete("k")
    assert cache.get("k") is None
    for call in (lambda: cache.set("k", "v", 0), lambda: cache.get(" ")):
        with pytest.raises(InvalidRequestError):
            call()
    with pytest.raises(DependencyUnavailableError):
        cache.set("k", 5, 1)


def test_table_is_made(spark):
    store.create_observations(spark, "made_here")
    assert spark.table("made_here").columns == ["consumer_id", "timestamp", "value_mw", "day"]
    spark.sql("DROP TABLE made_here")


def entries(spark, *rows):
    return spark.createDataFrame([("d", c, i, "t", [float(x) for x in v]) for i, (c, v) in enumerate(rows)], "document_id string, chunk_id string, ordinal int, text string, vector array<double>")


def test_vector_index_and_search(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = entries(spark, ("a", (1, 0)), ("b", (0, 2)), ("c", (3, 3)))
    assert vectors.collection_state(spark, path, 2) == "absent"
    assert vectors.ensure_collection(spark, path, 2) and not vectors.ensure_collection(spark, path, 2)
    assert vectors.index(rows, path, 2, "ordinal", "text") == 3 and vectors.index(rows, path, 2, "ordinal", "text") == 0
    assert vectors.collection_state(spark, path, 2) == "ready"
    for dimension, distance in ((3, "cosine"), (2, "dot")):
        with pytest.raises(ConflictError):
            vectors.collection_state(spark, path, dimension, distance)
    with pytest.raises(InvalidRequestError):
        vectors.ensure_collection(spark, path, 0)
    stored = spark.read.parquet(path)
    with pytest.raises(DependencyUnavailableError):
        vectors.require_stored(vectors.fingerprinted(entries(spark, ("q", (1, 1))), "vector"), stored)
    with pytest.raises(ConflictError):
        vectors.require_stored(vectors.fingerprinted(rows, "vector"), stored)
    with pytest.raises(ConflictError):
        vectors.index(rows.withColumn("text", F.lit("u")), path, 2, "ordinal", "text")
    for bad in (entries(spark, ("z", (1, 2, 3))), entries(spark, ("z", (1, float("nan"))))):
        with pytest.raises(InvalidRequestError):
            vectors.index(bad, path, 2, "ordinal", "text")
    stored = spark.read.parquet(path)
    ranked = lambda d: [r.chunk_id for r in vectors.search(stored, [1.0, 0.0], 3, d).orderBy("rank").collect()]
    assert ranked("cosine") == ["a", "c", "b"] and ranked("dot") == ["c", "a", "b"]
    assert ranked("euclid") == ["a", "b", "c"] and ranked("manhattan") == ["a", "b", "c"]
    for call in (lambda: vectors.search(stored, [1.0], 0), lambda: vectors.search(stored, [1.0], 1, dimension=2), lambda: vectors.search(stored, [1.0], 1, "other")):
        with pytest.raises(InvalidRequestError):
            call()


def test_documents_to_answers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "first line\r\n\r\n  second  \rthird"), (2, None)], "doc_id bigint, text string")
    chunks = documents.split_chunks(docs)
    assert [(r.chunk_id, r.ordinal, r.text, r.page_number) for r in chunks.orderBy("ordinal").collect()] == [("1:0", 0, "first line", 1), ("1:1", 1, "second", 3), ("1:2", 2, "third", 4)]
    model = lambda texts: [[float(len(t)), 1.0] for t in texts]
    path = str(tmp_path / "v")
    assert documents.index_chunks(chunks, model, path, 2) == 3
    assert documents.index_chunks(chunks.limit(0), None, path, 2) == 0
    answer = [{"constraint_id": "x", "evidence_chunk_ids": ["1:0"]}]
    assert documents.infer_constraints(spark, "question", 3, model, path, lambda found: answer) == answer
    with pytest.raises(DependencyUnavailableError):
        documents.infer_constraints(spark, "question", 1, model, path, lambda found: [{"evidence_chunk_ids": ["other"]}])
    with pytest.raises(InvalidRequestError):
        documents.embed_query("  ", model)
    with pytest.raises(DependencyUnavailableError):
        documents.embed_query("q", lambda t: [])


def test_pages_of_files(spark, tmp_path):
    for name, content in (("a.pdf", b"one\f\ftwo \r\n"), ("b.pdf", b"\f "), ("c.pdf", b"!bad")):
        (tmp_path / name).write_bytes(content)

    def reader(content):
        if content.startswith(b"!"):
            raise ValueError
        return content.decode().split("\f")

    chunks, notes = documents.extract_pages(spark, str(tmp_path), reader)
    assert [(r.ordinal, r.text, r.page_number) for r in chunks.orderBy("ordinal").collect()] == [(0, "one", 1), (1, "two", 3)]
    assert sorted(r.code for r in notes.collect()) == ["document_unreadable", "document_without_text"]


def test_record_rules(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (nan,), (float("inf"),), (None,)], "x double")
    got = [tuple(r) for r in rows.select(schemas.non_negative(F.col("x")), schemas.positive(F.col("x")), schemas.unit_interval(F.col("x"))).collect()]
    assert got == [(True, True, True), (True, False, True)] + [(False, False, False)] * 4
    texts = spark.createDataFrame([("  \t",), ("AMD",), ("AMD\n",), (None,)], "t string")
    assert [tuple(r) for r in texts.select(schemas.non_empty(F.col("t")), schemas.currency_code(F.col("t"))).collect()] == [(False, False), (True, True), (True, False), (False, False)]
    assert spark.createDataFrame([([],), ([1.0, nan],), ([1.0],)], "v array<double>").select(schemas.vector(F.col("v")).alias("g")).toPandas().g.tolist() == [False, False, True]
    assert spark.createDataFrame([], schemas.RECORDS["settlement"]).count() == 0
    assert spark.range(1).select(schemas.dead_letter_holds(F.array())).first()[0] is False


def test_scalar_texts(spark):
    space = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    rows = [("d", "c"), ('é"x', "a,b"), ("", "\n")] + [(str(i), "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "d string, c string")
    import json

    found = [r[0] for r in frame.select(normalize.point_uuid(space, F.col("d"), F.col("c"))).collect()]
    assert found == [str(uuid.uuid5(space, json.dumps([d, c], separators=(",", ":"), ensure_ascii=False))) for d, c in rows]
    one = spark.sql("SELECT timestamp_ntz'2026-01-02 03:04:05' AS a, timestamp_ntz'2026-01-02 03:04:05.0607' AS b, 'a-b:1' AS c, 'a b' AS d, cast('1E+3' as string) AS n")
    row = one.select(normalize.utc_iso(F.col("a")), normalize.utc_iso(F.col("b")), normalize.correlation_id(F.col("c")), normalize.correlation_id(F.col("d")), normalize.decimal_text(normalize.decimal_amount(F.col("n"), 18, 2))).first()
    assert tuple(row) == ("2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.060700+00:00", "a-b:1", None, "1000.00")


def state(**changes):
    return workflow.State(**({"workflow_id": "w", "portfolio_id": "p", "delivery_date": date(2026, 1, 2), "correlation_id": "c"} | changes))


def plan(fail=()):
    def job(name):
        def run():
            if name in fail:
                raise fail[name]
            return name

        return run

    return {p: (lambda s, a=a: {n: job(n) for n in a}) for p, a in (("ingestion", workflow.INGESTION_AGENTS), ("forecasting", workflow.FORECASTING_AGENTS))}


def test_workflow_moves_on_and_fails(spark):
    results = {"ingestion": workflow.Results(), "forecasting": workflow.Results()}
    flow = workflow.Workflow(plan(), results)
    after = flow.step(flow.step(state()))
    assert (after.phase, after.status) == ("risk_and_bid", "running")
    assert flow.step(state()).phase == "forecasting"
    assert workflow.assess_risk(after, results["forecasting"], lambda s, f: sorted(f)) == ["load", "price"]
    assert workflow.propose(after, results["forecasting"], 1, lambda s, f, r: [r])["bids"] == (1,)
    with pytest.raises(InvalidRequestError):
        flow.step(after)
    failed = workflow.Workflow(plan({"load": ConflictError()}), results).step(state(phase="forecasting"))
    assert (failed.phase, failed.status, failed.diagnostics) == ("forecasting", "failed", ("load:conflict",))
    odd = workflow.Workflow(plan({"price": ValueError()}), results).step(state(phase="forecasting"))
    assert odd.diagnostics == ("price:forecasting_unexpected_failure",)
    with pytest.raises(InvalidRequestError):
        workflow.Workflow(plan({"price": ValueError(), "load": ValueError()}), results).step(state(phase="forecasting"))
    with pytest.raises(NotImplementedError):
        workflow.Workflow(plan({"price": ValueError()}), results).step(state(phase="forecasting"), lambda f: "retry")


def test_workflow_results_and_rules():
    results = workflow.Results()
    results.put("w", 1)
    results.put("w", 1)
    with pytest.raises(ConflictError):
        results.put("w", 2)
    with pytest.raises(NotFoundError):
        results.get("v")
    nested = ExceptionGroup("x", [workflow.AgentError("a", ValueError()), ExceptionGroup("y", [workflow.AgentError("b", NotFoundError())])])
    assert [(f.agent, f.code) for f in workflow.failures_of(nested, "ingestion")] == [("a", "ingestion_unexpected_failure"), ("b", "not_found")]
    with pytest.raises(InvalidRequestError):
        workflow.failures_of(ExceptionGroup("x", [ValueError()]), "ingestion")
    for changes in ({"delivery_date": datetime(2026, 1, 2)}, {"phase": "x"}, {"workflow_id": " "}):
        with pytest.raises(InvalidRequestError):
            state(**changes)
