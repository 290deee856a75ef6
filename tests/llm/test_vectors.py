"""Embedding near duplicates and vector codes against brute-force versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from ampereflow.llm import codes, embed_dedup

VECTORS = "vec_id bigint, embedding array<double>, label int, key string, node int, n_links string, codes string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Vectors with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, v, label, "k", 1, "x", "y") for i, v, label in rows], VECTORS)


def near_brute(rows, threshold):
    def real(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, v, x), (_, w, y) = rows[a], rows[b]
            if x is None or x != y or not real(v) or not real(w) or len(v) != len(w):
                continue
            p, q = (np.array(z) / np.abs(z).max() for z in (v, w))
            if p @ q / math.sqrt((p @ p) * (q @ q)) >= threshold:
                near[a].append(b)
                near[b].append(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[a][0], len(near[a]), least, rows[a][0] is not None and rows[a][0] == least))
    return sorted(out, key=str)


def cloud(size=12, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 1, 1, 2):
        centre = rng.normal(size=size)
        for spread in (0.02, 0.05, 0.08, 0.5):
            rows += [((centre + spread * rng.normal(size=size) * np.linalg.norm(centre) / math.sqrt(size)).tolist(), label) for _ in range(12)]
    rows += [(rows[0][0], 0), (rows[0][0], 0), (rows[0][0], 1), ([2 * x for x in rows[0][0]], 0), ([0.0] * size, 0), ([0.0] * size, 0), (None, 0), (None, None), ([], 0)]
    rows += [([NAN] * size, 0), ([INF] + [0.0] * (size - 1), 0), ([1.0] * (size - 1) + [None], 0), (rows[0][0], None), (rows[0][0], None), ([1e300] * size, 2), ([1e-300] * size, 2), ([1.0], 2), ([5.0], 2), ([-1.0], 2)]
    rows += [([0.0, 1.0], 2), ([-0.0, 1.0], 2)]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    return [(k if k % 17 else None, *rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("threshold", [0.98, 0.9, 0.3])
def test_near_duplicates_match_brute_force(spark, threshold):
    rows = cloud() + [(3, cloud()[5][1], 1), (3, cloud()[5][1], 1)]
    found = embed_dedup.near_duplicates(table(spark, rows), threshold=threshold).collect()
    assert sorted(map(tuple, found), key=str) == near_brute(rows, threshold)


def test_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "SQUARE", 8)
    monkeypatch.setattr(embed_dedup, "PAIRS", 32)
    rows = cloud(40, 6)
    found = embed_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == near_brute(rows, 0.98)
    cut = embed_dedup.blocks(embed_dedup.nodes(table(spark, rows), "vec_id", "embedding", "label")[1], {s: np.eye(s) for s in (1, 2, 40)}, "<f8")
    assert cut.groupBy("block").count().agg({"count": "max"}).first()[0] <= 16
    assert cut.groupBy("block").agg({"label": "min", "label": "max"}).count() > 10
    far = embed_dedup.tiles(cut, 0.98).count()
    blocks = cut.groupBy("label", "size").agg({"block": "count"}).count()
    assert blocks <= far


def test_blocks_far_apart_make_no_tile(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 10)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(6):  # six bunches around a circle
        for _ in range(10):
            angle = k + 0.001 * rng.normal()
            rows.append((len(rows), [math.cos(angle), math.sin(angle)], 7))
    _, found, kind = embed_dedup.nodes(table(spark, rows), "vec_id", "embedding", "label")
    cut = embed_dedup.blocks(found, embed_dedup.axes(found, kind), kind)
    tiles = embed_dedup.tiles(cut, 0.98).count()
    count = cut.select("block").distinct().count()
    assert tiles < count * (count + 1) // 2
    assert sorted(map(tuple, embed_dedup.near_duplicates(table(spark, rows)).collect()), key=str) == near_brute(rows, 0.98)


def test_a_large_bunch_gives_few_rows(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.001 * rng.normal(size=16)).tolist(), 1) for i in range(1500)]
    _, found, kind = embed_dedup.nodes(table(spark, rows), "vec_id", "embedding", "label")
    turns = embed_dedup.axes(found, kind)
    near = embed_dedup.compare(embed_dedup.blocks(found, turns, kind), turns, kind, 0.98).collect()
    assert len(near) == 1500 and {r.links for r in near} == {1499} and len({r.root for r in near}) == 1


def test_drop_keeps_columns_and_empty_tables(spark):
    rows = [(2, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (9, None, 1)]
    kept = embed_dedup.drop_near_duplicates(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in VECTORS.split(", ")]
    assert sorted((r.vec_id for r in kept.collect()), key=str) == [1, 3, 9, None]
    assert embed_dedup.near_duplicates(table(spark, [])).count() == 0
    assert embed_dedup.drop_near_duplicates(table(spark, [])).count() == 0


def test_join_merges_classes():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 200, 90), rng.integers(0, 200, 90)
    root = np.arange(200)
    embed_dedup.join(root, u[:40], v[:40])
    embed_dedup.join(root, u[40:], v[40:])
    expected = np.arange(200)
    for _ in range(200):
        for a, b in zip(u, v):
            expected[[a, b]] = min(expected[a], expected[b])
    assert np.array_equal(root, expected)


def codes_brute(rows, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 8 == 0]
    if not kept:
        return [], ""
    bound = 1 << 26
    ints = [[max(-bound, min(bound, math.floor(4096 * x))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, np.array(ints[k], "<i4").tobytes()))
    size = len(kept[order[0]][1])
    order = [k for k in order if len(kept[k][1]) == size]
    w = size // 8
    parts = {k: [ints[k][p * w : (p + 1) * w] for p in range(8)] for k in order}
    books = [[parts[k][p] for k in order[:16]] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for k in order:
                groups.setdefault(nearest(p, parts[k][p])[1], []).append(parts[k][p])
            new = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))]
            books[p] = new
    out = []
    for k in order:
        best = [nearest(p, parts[k][p]) for p in range(8)]
        out.append((kept[k][0], kept[k][2], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label]) for i, label, code, error in out), key=str), digest


def code_rows(n=90, size=16):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=size) * 0.3).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows[5] = (5, rows[4][1], None)
    rows += [(3, rows[7][1], 1), (3, rows[7][1], 1), (None, rows[8][1], None), (500, [NAN] * size, 1), (501, None, 1), (502, [INF] * size, 1), (503, [], 1), (504, [1.0] * 7, 1), (505, [1.0] * 24, 1), (506, [None] * size, 1)]
    return rows[::-1]


@pytest.mark.parametrize("extra", [[], [(600, [3000.0] * 16, 2), (601, [-1e9] + [0.0] * 15, 2)]])
def test_codes_match_brute_force(spark, extra):
    rows = code_rows() + extra
    coded, books = codes.compress(table(spark, rows))
    found = codes.with_label_error(coded).collect()
    expected, digest = codes_brute(rows)
    assert sorted(((r.id, r.codes.hex(), r.error, r.label_error) for r in found), key=str) == expected
    assert codes.digest(books) == digest


def test_fewer_rows_than_entries_ties_and_empty(spark):
    rows = [(1, [0.0] * 8, 1), (2, [1.0] * 8, 1), (3, [0.5] * 8, 1)]
    coded, books = codes.compress(table(spark, rows))
    assert books.shape == (8, 3, 1)
    assert sorted((r.id, r.codes.hex(), r.error) for r in coded.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0), (3, "02" * 8, 0)]
    same, books = codes.compress(table(spark, [(i, [0.25] * 8, 1) for i in range(40)]))
    assert {r.codes.hex() for r in same.collect()} == {"00" * 8}
    for none in ([], [(1, None, 1), (2, [1.0] * 3, 1)]):
        coded, books = codes.compress(table(spark, none))
        assert codes.with_label_error(coded).count() == 0 and books.size == 0


def test_rounds_shuffle_only_contributions(spark):
    """A round's join reads vectors and assignments bucket by bucket, and batches without moves add nothing."""
    rows = codes.integers(table(spark, code_rows()), "vec_id", "embedding", "label").filter("size = 16").select("row", "ints")
    folder = f"{codes.shared_dir(spark)}/plans"
    base = codes._bucketed(rows.repartition(4, "row"), "plan_base", 4, folder)
    books = np.random.default_rng(1).integers(-2000, 2000, (8, 16, 2))
    first = codes._bucketed(codes._assign(base, books, False), "plan_0", 4, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = base.join(first.select("row", "codes"), "row").select("row", "ints", "codes")
        again = codes._assign(joined, books, True)
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        assert again.filter("deltas is not null").count() == 0
        assert {r["row"]: r.codes for r in again.collect()} == {r["row"]: r.codes for r in first.collect()}
        books[0, 0] += 700
        counts, sums = np.zeros((8, 16), np.int64), np.zeros((8, 16, 2), np.int64)
        codes._add(first, counts, sums)
        moved = codes._assign(joined, books, True)
        codes._add(moved, counts, sums)
        fresh, whole = np.zeros((8, 16), np.int64), np.zeros((8, 16, 2), np.int64)
        codes._add(codes._assign(base, books, False), fresh, whole)
        assert np.array_equal(counts, fresh) and np.array_equal(sums, whole)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        codes._forget(spark, "plan_base")
        codes._forget(spark, "plan_0")


def test_decompress_gives_the_entries(spark):
    coded, books = codes.compress(table(spark, code_rows(30)))
    for r in codes.decompress(coded, books).limit(10).collect():
        expected = np.concatenate([books[p, e] for p, e in enumerate(r.codes)]) / 4096
        assert np.allclose(r.vector, expected)
