import pytest

from ampereflow.errors import InvalidRequestError
from ampereflow.operators import vectors
from ampereflow.plans import catalog


def test_every_twentieth_row_is_a_query(spark):
    sf = "/root/testdata/sf0.001"
    asked = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    found = catalog.QUERIES["knn_batch_cosine"](spark, sf).collect()
    assert len(asked) > 1 and {r.query_id for r in found} == asked and len(found) == 10 * len(asked)


@pytest.mark.parametrize("block", [1, 2048])
def test_batch_equals_single_searches(spark, block):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(30, None), (31, [1.0])], "vec_id bigint, vector array<double>")
    found = vectors.search_all(rows, rows.filter("vec_id in (0, 7)"), 4, "euclid", block=block).collect()
    for asked in (0, 7):
        single = vectors.search(rows, rows.filter(f"vec_id = {asked}").first().vector, 4, "euclid", key=("vec_id",)).collect()
        assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == asked) == sorted((r.rank, r.vec_id, r.score) for r in single)
    with pytest.raises(InvalidRequestError):
        vectors.search_all(rows, rows, 4)


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid", "manhattan"])
def test_small_tiles_equal_a_plain_sort(spark, distance):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors_of = {i: rng.integers(-2, 3, 5).astype(float).tolist() for i in range(300)}  # many ties
    vectors_of[300] = [0.0] * 5
    rows = spark.createDataFrame([*vectors_of.items(), (301, None), (302, [1.0]), (303, [float("nan")] * 5)], "vec_id bigint, vector array<double>")
    found = vectors.search_all(rows, rows.filter("vec_id % 20 = 1 and vec_id < 300"), 7, distance, block=4, tile=40)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    sign = -1 if distance in ("cosine", "dot") else 1
    for q in range(1, 300, 20):
        scores = vectors._tile(distance, np.array([vectors_of[q]]), np.array([vectors_of[i] for i in range(301)]))[0]
        order = sorted(range(301), key=lambda i: (np.isnan(scores[i]), sign * scores[i] if not np.isnan(scores[i]) else 0, i))
        assert [i for _, i in sorted(got[q])] == order[:7]


def test_more_asked_than_there_are_and_no_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id bigint, vector array<double>")
    found = vectors.search_all(rows, rows.filter("vec_id = 1"), 10).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 1.0), (2, 3, 0.0), (3, 2, None)]
    assert vectors.search_all(rows, rows.filter("vec_id = 99"), 10).count() == 0
    assert vectors.search_all(rows.filter("vec_id = 99"), rows.filter("vec_id = 1"), 10).count() == 0


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid", "manhattan"])
def test_few_pairs_are_scored_exactly(monkeypatch, distance):
    import numpy as np

    drawn, scored, plain = np.random.default_rng(4).normal(size=(9000, 16)), [], vectors._scores
    monkeypatch.setattr(vectors, "_scores", lambda d, a, b: scored.append(np.prod(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))) or plain(d, a, b))
    found = vectors._nearest_of_tile(np.arange(40), drawn[:40], np.arange(9000), drawn, 10, distance)
    assert len(found[0]) == 400 and sum(scored) < 0.02 * 40 * 9000


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid", "manhattan"])
def test_odd_sizes_and_values_equal_a_plain_sort(distance):
    import numpy as np

    drawn = np.random.default_rng(6).normal(size=(5000, 6))
    for k, scale in enumerate([1e-170, 1e-30, 1e30, 1e160, 1e300]):
        drawn[k::9] *= scale
    drawn[7::90], drawn[8::90, 2], drawn[17::90, 1], drawn[26::450] = 0.0, np.nan, np.inf, drawn[0]
    ids, sign = np.arange(5000)[::-1], -1 if distance in ("cosine", "dot") else 1
    with np.errstate(all="ignore"):
        query_ids, found, _ = vectors._nearest_of_tile(np.arange(60), drawn[:60], ids, drawn, 12, distance)
        values = vectors._tile(distance, drawn[:60], drawn)
    for q in range(60):
        order = np.lexsort((ids, np.where(np.isnan(values[q]), np.inf, sign * values[q])))[:12]
        assert sorted(found[query_ids == q]) == sorted(ids[order])


def test_partitions_follow_the_number_of_groups(spark):
    rows = spark.range(400).selectExpr("id AS vec_id", "array(double(id), 1.0D) AS vector")
    found = vectors.search_all(rows, rows.filter("vec_id % 20 = 0"), 3, "euclid", block=5, tile=40)
    assert "hashpartitioning(query_block" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 80), REPARTITION_BY_NUM" in plan
    assert found.count() == 60
