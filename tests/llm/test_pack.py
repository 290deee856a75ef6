import zlib

import numpy as np
import pytest

from ampereflow.llm import pack

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  a  b", " a\nb", "a\n b", "x\n\ny z", "a b ", "a\tb c", "a\x1cb cd", "\n", "a \nb", "l'été d'un 's it's\nx", "  \n \n  a", "日本 語\u3000x", "a b\nc\nd e.", "w!!! v%%% don't. a's.", "<|endoftext|> x", "<|endoftext|>", "a b <|endoftext|>", "wor<|endoftext|>d and <|endoftext|><|endoftext|> so  on\n<|endoftext|>\n", "<|endoftext|", "a <|ENDOFTEXT|> b", "a\u00a0b c", "x" * 3000]


def test_cached_words_have_the_tokenizers_ids(spark, tokenizer, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for cache in (200_000, 5):
        monkeypatch.setattr(pack, "_CACHE", cache)
        encoder = pack.Encoder(*pack.registered_vocabulary())
        found = [x for i in range(0, len(texts), 7) for x in encoder.encode(texts[i : i + 7])]
        assert found == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_round_trip_and_sequences(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(pack, "SHARD", 40)
    texts = ODD + [None, "word " * 1023, "word " * 1022, "word " * 2047, "word " * 5000] + [f"tok{i} " * (i * 7 % 900) for i in range(120)]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(3, texts[3], 3), (None, "no id", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    found = pack.pack_documents(docs, *pack.registered_vocabulary()).toPandas()
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [pack.END_ID], "<u4")
        own = found[found.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert own.length.iloc[1:].eq(pack.CAPACITY).all() and len(own) == -(-len(ids) // pack.CAPACITY)
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    assert (found.doc_id == 3).sum() == 2 and found.doc_id.isna().sum() == 1
    ordered = found.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= pack.CAPACITY
    assert pack.pack_documents(docs.limit(0), *pack.registered_vocabulary()).count() == 0


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([6, 5, 4, 5, 3])
    assert pack.best_fit(sizes, np.arange(5), 10).tolist() == [0, 1, 0, 1, 2]


def test_exact_fill_finds_what_best_fit_misses():
    sizes = np.array([7, 6, 4, 4, 3, 3, 2, 1, 5, 5])
    found = pack.exact_fill(sizes, np.arange(10), 10)
    assert np.bincount(found, sizes).tolist() == [10] * 4
    rng = np.random.default_rng(4)
    for capacity in (12, 100, 1024):
        for _ in range(20):
            sizes = rng.integers(1, capacity, 60)
            found = pack.exact_fill(sizes, rng.permutation(60), capacity)
            assert np.bincount(found, sizes).max() <= capacity and (np.bincount(found) > 0).all()


def test_pool_finds_exact_sums():
    sizes = [5, 5, 3, 2]
    pool = pack.Pool(sizes, [0, 1, 2, 3], 20)
    assert pool.exact(10) == (5, 5) and pool.exact(8) == (5, 3) and pool.exact(12) == (5, 5, 2) and pool.exact(6) == () and pool.exact(3) == (3,)
    pool.take(5)
    assert pool.exact(10) == (5, 3, 2) and pool.largest(4) == 3 and pool.largest(1) < 1


def test_crossover_keeps_every_item_once_and_within_capacity():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1024, 500)
    mother, father = (pack.best_fit(sizes, rng.permutation(500), 1024) for _ in range(2))
    for _ in range(30):
        child = pack.crossover(sizes, mother, father, 1024, rng)
        assert len(child) == 500 and child.min() == 0 and np.bincount(child, sizes).max() <= 1024
        assert (np.bincount(child) > 0).all()
        mother, father = father, child


def test_small_sets_are_packed_into_the_least_number():
    """Against all ways to share out eight items."""
    from functools import cache

    rng = np.random.default_rng(11)
    for _ in range(25):
        sizes = np.sort(rng.integers(1, 20, 8))

        @cache
        def least(left: frozenset) -> int:
            if not left:
                return 0
            first, *others = sorted(left)
            ways = [[first]]
            for item in others:
                ways += [w + [item] for w in ways if sum(int(sizes[i]) for i in [*w, item]) <= 20]
            return 1 + min(least(left - frozenset(w)) for w in ways)

        assert pack.evolve(sizes, [], 20, 1)[0].max() + 1 == least(frozenset(range(8)))


def test_evolution_never_loses_the_best(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(100, 700, 400))
    first = pack.best_fit(sizes, np.argsort(-sizes, kind="stable"), 1024)
    best = pack.evolve(sizes, [], 1024, 1)[0]
    assert pack.fitness(sizes, best, 1024) >= pack.fitness(sizes, first, 1024)
