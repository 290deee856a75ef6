import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ampereflow.llm import components, exact_dedup, simhash

SCHEMA = "doc_id bigint, text string, sha256 string, keep_id string, fp int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, "x" * 200_000), (7, "x" * 200_000), (8, "x" * 199_999 + "y"), (6, "é\u00a0b"), (None, "a b"), (3, "a\tb"), (10, "solo")]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_exact_matches_brute_force(spark, limit):
    found = exact_dedup.exact_duplicates(docs(spark, ROWS)).collect()
    assert sorted(map(tuple, found), key=str) == exact_brute(ROWS)
    groups = exact_dedup.duplicate_groups(docs(spark, ROWS), broadcast_rows=limit).collect()
    assert sorted((r.keep_id, r.group_size) for r in groups) == [(1, 2), (3, 4), (4, 2)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_exact_drop_keeps_columns(spark, limit):
    kept = exact_dedup.drop_exact_duplicates(docs(spark, ROWS), broadcast_rows=limit)
    assert kept.columns == ["doc_id", "text", "sha256", "keep_id", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4, 6, 8, 9, 10]


def test_exact_only_null_ids(spark):
    found = exact_dedup.exact_duplicates(docs(spark, [(None, "a"), (None, "a")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in found] == [(None, 2, True)] * 2


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def fingerprint_brute(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components_brute(fps):
    """Smallest id reachable over links of four bits or fewer."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(fps):
        for j, y in fps[:a]:
            if (x ^ y).bit_count() <= 4:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in fps}


def near_texts():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    rows = [(100, ""), (101, None), (102, "one"), (103, "One two THREE"), (104, "é É a"), (105, " \t\n")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 900]))]
        for k in range(8):
            text = list(base)
            for _ in range(k // 2):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 - 10 * g - k, " ".join(text)))
    return rows


def test_simhash_matches_brute_force(spark):
    rows = near_texts()
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [(i, fingerprint_brute(t or "")) for i, t in rows]
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{x:016x}" for i, x in fps}
    assert {i: r.component_id for i, r in found.items()} == components_brute(fps)
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "sha256", "keep_id", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components_brute(fps).values()))


def test_spark_hash_is_the_fingerprint_hash(spark):
    import xxhash

    value = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h
    assert value % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_long_lists_are_linked_in_blocks(spark, monkeypatch, block):
    """Dense balls of fingerprints, with lists cut into very small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(15)}
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for _, x in rows], "fp bigint")
    lists = simhash._index(signed).repartition("slot", "key").sortWithinPartitions("slot", "key", "fp").toPandas()
    import pyarrow as pa

    batches = list(simhash._lists(iter(pa.Table.from_pandas(lists, preserve_index=False).to_batches(max_chunksize=7))))
    table = spark.createDataFrame([tuple(r.values()) for r in pa.Table.from_batches(batches).to_pylist()], "u bigint, v bigint, slot int, key int, block int")
    links = table.filter("block is null").select("u", "v")
    if table.filter("block is not null").count():
        links = links.union(simhash._block_pairs(table.filter("block is not null")))
    place = {x: i for i, x in rows}
    found = {}
    for r in components.connected_components(links).collect():
        found[place[r.node % 2**64]] = r.root
    expected = components_brute(rows)
    groups = {}
    for i, root in expected.items():
        groups.setdefault(root, set()).add(i)
    ours = {}
    for i, root in found.items():
        ours.setdefault(root, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_dense_list_gives_fewer_links_than_members():
    import numpy as np

    members = np.array([1 << b for b in range(40)] + [0], np.int64)
    u, v = simhash.link(members)
    assert len(u) == len(members) - 1


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (1000, 1001), (1001, 1000)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {500 + i: 500 for i in range(50)} | {1000: 1000, 1001: 1000}
