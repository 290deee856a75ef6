"""Alignment of two tokenizers over the bytes of each text.

A byte-level vocabulary A and a sentence-piece vocabulary B cut the same bytes, a space and the text. Where a
token of each ends at the same byte, the text is cut into groups; two tokens whose bytes overlap are
linked.

A batch of texts is laid end to end: one array of A's ends and one of B's, counted by byte once for all
texts. Bytes where both count one are the cuts. Each stretch between neighbouring ends, whosoever they
are, lies in one token of A and one of B, and each overlapping pair has just one such stretch, so links
are the ends of either and their tokens are prefix sums of the counts. The prefix sums at the texts'
last bytes, less those before, are each text's own figures.
"""

from __future__ import annotations

import re
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize, text_or_empty
from .pack import _ODD, _RUNS, Encoder

BYTE_VOCABULARY, BYTE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Characters of one window of a long text, and of the texts that are laid end to end at once.
WINDOW = 1 << 19
#: Words with known tokens in a task's memory, and tokens of A that are kept there.
KNOWN = 400_000
TOKENS = 8_000_000
#: New words that are encoded at once.
TOGETHER = 4096
#: Most id pairs that are broadcast; a larger table of pairs is joined by a shuffle.
PAIRS_BROADCAST = 1_000_000
_SHIFT = 16
_JOINT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "row {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, pair_links array<int>"


def windows(text: str) -> list[str]:
    """``text`` cut at single spaces between non-spaces, where no token of either vocabulary reaches across.

    A space before each window gives a space and the text again. A stretch without such a space stays whole.
    """
    out, start = [], 0
    while len(text) - start > WINDOW:
        cut = _JOINT.search(text, start + WINDOW)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


class Known(dict):
    """Words by number; a word that is new gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Side:
    """One vocabulary's tokens of numbered texts, end to end; a text with a negative count has none."""

    def __init__(self):
        self.ids, self.counts, self.parts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), [], []

    def add(self, ids, counts) -> None:
        self.parts.append(np.asarray(ids, np.int64))
        self.sizes.append(np.asarray(counts, np.int64))

    def settle(self) -> None:
        if self.parts:
            self.ids, self.counts = np.concatenate([self.ids, *self.parts]), np.concatenate([self.counts, *self.sizes])
            self.starts = np.cumsum(np.maximum(self.counts, 0)) - np.maximum(self.counts, 0)
            self.parts, self.sizes = [], []

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered texts in order, and how many each has."""
        counts = np.maximum(self.counts[numbers], 0)
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class Pair:
    """Tokens of both vocabularies for a space and a text, where their bytes are those of the text."""

    def __init__(self, ranks: str, pattern: str, model: str):
        import sentencepiece

        self.tokens = Encoder(ranks, pattern).tokens
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a = self._byte_level(ranks)
        self.bytes_b = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.len_a, self.len_b = (np.fromiter(map(len, b), np.int64, len(b)) for b in (self.bytes_a, self.bytes_b))
        self.known, self.a, self.b = Known(), Side(), Side()
        size = len(self.bytes_a)
        #: A token's id with what follows it: within a side, at the end of a side.
        self.said = [f"{i}{mark}".encode() for i in range(size) for mark in ",|"] + [f"{i}{mark}".encode() for i in range(len(self.bytes_b)) for mark in ",;"]
        self.first_b = 2 * size

    @staticmethod
    def _byte_level(ranks: str) -> list[bytes]:
        import base64

        with open(ranks, "rb") as lines:
            found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        return [found.get(i, b"") for i in range(max(found) + 1)]

    def _piece(self, number: int) -> bytes:
        if self.model.is_byte(number):
            return bytes([int(self.model.id_to_piece(number)[3:-1], 16)])
        if self.model.is_control(number) or self.model.is_unknown(number):
            return b""
        return self.model.id_to_piece(number).replace("▁", " ").encode()

    def _same(self, a: list[int], b: list[int], expected: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == expected and b"".join(map(self.bytes_b.__getitem__, b)) == expected

    def _learn(self, words: list[str]) -> None:
        """Tokens of a space and each word; of the word alone where it begins with a line break.

        Many words are given to A as one text, as no token reaches into the space or line break before
        the next. Where the bytes differ, each word is tried by itself.
        """
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            if not self._learn_together(part):
                for word in part:
                    if not self._learn_together([word]):
                        self.a.add([], [-1])
                        self.b.add([], [-1])

    def _learn_together(self, words: list[str]) -> bool:
        said = [w if w[:1] == "\n" else " " + w for w in words]
        text = "".join(said)
        a, parts = self.tokens(text), self.model.encode(words, num_threads=1)
        parts = [b[1:] if w[:1] == "\n" else b for w, b in zip(words, parts)]  # less B's own space
        b = list(chain.from_iterable(parts))
        if not self._same(a, b, text.encode()):
            return False
        counts_b = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in said), np.int64, len(said)))
        if not np.array_equal(np.cumsum(self.len_b[b])[np.cumsum(counts_b) - 1], ends):
            return False
        self.a.add(a, np.diff(np.searchsorted(np.cumsum(self.len_a[a]), ends, "right"), prepend=0))
        self.b.add(b, counts_b)
        return True

    def _whole(self, text: str) -> int:
        """The number of a text that isn't made of words with single spaces; it isn't remembered by its words."""
        a, b = self.tokens(" " + text), self.model.encode(text, num_threads=1)
        good = bool(text) and self._same(a, b, b" " + text.encode())
        self.a.add(a if good else [], [len(a) if good else -1])
        self.b.add(b if good else [], [len(b) if good else -1])
        number = len(self.known)
        self.known[number] = number  # takes the number; no word equals it
        return number

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """By text, the numbers of its words and whether all are known to both sides."""
        if len(self.known) > KNOWN or len(self.a.ids) > TOKENS:
            self.known, self.a, self.b = Known(), Side(), Side()
        plain = [bool(t) and not (_ODD.search(t) or any(x in t for x in _RUNS) or t[0] in " \n" or t[-1] in " \n") for t in texts]
        words = [t.replace("\n", " \n").split(" ") if p else [] for t, p in zip(texts, plain)]
        sizes = list(map(len, words))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        self._learn(self.known.new)
        self.known.new = []
        out = np.split(numbers, np.cumsum(sizes)[:-1])
        out = [n if p else np.array([self._whole(t)]) for n, t, p in zip(out, texts, plain)]
        self.a.settle()
        self.b.settle()
        return out, np.array([(self.a.counts[n] >= 0).all() for n in out], bool)

    def align(self, found: list[np.ndarray]) -> list[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]]:
        """``(n_a, n_b, n_groups, n_links, groups, pairs, links)`` of each text of a batch laid end to end; texts by their words' numbers."""
        numbers, firsts = np.concatenate(found), np.cumsum([0, *map(len, found[:-1])])
        (a, n_a), (b, n_b) = ((ids, np.add.reduceat(counts, firsts)) for ids, counts in (self.a.of(numbers), self.b.of(numbers)))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        size = int(end_a[-1]) + 1
        at_a, at_b = np.bincount(end_a, minlength=size), np.bincount(end_b, minlength=size)
        both = at_a & at_b
        upto_a, upto_b, upto_both = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(both)
        last = end_a[np.cumsum(n_a) - 1]  # the last byte of each text
        n_groups = np.diff(upto_both[last], prepend=0)
        # Links: each end of either, with the tokens that the stretch before it lies in.
        ends = np.flatnonzero(at_a | at_b)
        pair = (a[upto_a[ends] - at_a[ends]] << _SHIFT) | b[upto_b[ends] - at_b[ends]]
        n_links = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        keys, links = np.unique((np.repeat(np.arange(len(found)), n_links) << 33) | pair, return_counts=True)
        bounds = np.searchsorted(keys >> 33, np.arange(len(found) + 1))
        keys &= (1 << 33) - 1
        # Groups as text: A's tokens of a group stand before B's.
        cuts = np.flatnonzero(both)
        group_a, group_b = upto_both[end_a] - both[end_a], upto_both[end_b] - both[end_b]
        before = np.concatenate([[0], upto_b[cuts]])
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + before[group_a]] = 2 * a + both[end_a]
        words[np.arange(len(b)) + upto_a[cuts][group_b]] = self.first_b + 2 * b + both[end_b]
        texts, spoken = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist(), list(map(self.said.__getitem__, words.tolist()))
        rows = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist())
        return [(*row, b"".join(spoken[texts[i] : texts[i + 1]])[:-1], keys[bounds[i] : bounds[i + 1]], links[bounds[i] : bounds[i + 1]]) for i, row in enumerate(rows)]

    def rows(self, texts: list[str]) -> tuple[list[int], list[int], list[int], list[int], list[str], list[np.ndarray], list[np.ndarray]]:
        """The columns of ``SCHEMA`` but the id for a batch of texts; windows of a long text are put together again."""
        parts = [windows(t) for t in texts]
        owner = [i for i, p in enumerate(parts) for _ in p]
        flat = [w for p in parts for w in p]
        found: dict[int, list] = {i: [] for i in range(len(texts))}
        start = 0
        for stop in self._stops(flat):
            encoded, good = self.encode(flat[start:stop])
            results = iter(self.align([n for n, g in zip(encoded, good) if g]) if good.any() else [])
            for k, g in zip(range(start, stop), good):
                found[owner[k]].append(next(results) if g else None)
            start = stop
        empty = np.empty(0, np.int64)
        out = []
        for i in range(len(texts)):
            results = [] if None in found[i] else found[i]
            if len(results) == 1:
                out.append(results[0])
                continue
            pairs, back = np.unique(np.concatenate([r[5] for r in results] or [empty]), return_inverse=True)
            links = np.bincount(back, np.concatenate([r[6] for r in results] or [empty]), len(pairs)).astype(np.int64)
            out.append((*(sum(r[c] for r in results) for c in range(4)), b";".join(r[4] for r in results), pairs, links))
        columns = list(zip(*out))
        columns[4] = [g.decode() for g in columns[4]]
        return tuple(map(list, columns))

    @staticmethod
    def _stops(texts: list[str]) -> list[int]:
        """Where to end batches of about ``WINDOW`` characters."""
        sizes = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
        whole = np.flatnonzero(np.diff(sizes // WINDOW, append=-1)) + 1
        return whole.tolist()


def align(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of each row's text under a byte-level vocabulary (A) and a sentence-piece model (B).

    Returns the id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``:
    ids of A and of B by group, in order) and the linked id pairs, ``pairs`` (A's id times 65536 plus B's)
    with ``pair_links``, how often the text links each. Strings of special tokens are plain text. Texts
    that are null or empty, and those whose bytes a side's tokens don't give back (a text with U+2581),
    have no tokens: zeros, an empty ``groups`` and no pairs. Ids are carried along, null and repeated ones
    too; texts of any length are read whole, in windows; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(ranks, pattern, model)
            start = 0
            texts = batch.column(1).to_pylist()
            for stop in Pair._stops(texts):
                n_a, n_b, n_groups, n_links, groups, pairs, links = pair.rows(texts[start:stop])
                offsets = pa.array(np.concatenate([[0], np.cumsum(list(map(len, pairs)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (links, pa.int32()))]
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *counts, pa.array(groups), *lists], names=names)
                start = stop

    schema = f"`id` {kind}, " + SCHEMA.split(", ", 1)[1]
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"]
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def lexicon(aligned: DataFrame) -> DataFrame:
    """``(pair, links, best)`` of all rows of :func:`align`: how many links hold the pair, and whether no pair of its B id has more.

    Counted before the shuffle; the maximum of a B id is taken over pairs, of which there are at most as
    many as A has ids.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.pair_links").cast("bigint").alias("n"))
    pairs = materialize(each.groupBy("pair").agg(F.sum("n").alias("links")), "pairs")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    most = pairs.groupBy(of_b.alias("b")).agg(F.max("links").alias("most"))
    return materialize(pairs.join(most, of_b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "lexicon")


def score(aligned: DataFrame, pairs: DataFrame, broadcast_rows: int = PAIRS_BROADCAST) -> DataFrame:
    """``aligned`` with ``n_best``, the links whose pair is among its B id's commonest, and ``count_sum``, their pairs' corpus-wide links summed.

    ``aligned`` must be a written table with a column ``row`` that tells its rows apart; ``pairs`` is its
    :func:`lexicon`, broadcast if it has at most ``broadcast_rows`` rows.
    """
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pair_links").cast("bigint").alias("n"))
    met = each.join(broadcast_within(pairs, broadcast_rows), "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    out = aligned.drop("pairs", "pair_links").join(sums, "row", "left")
    return out.withColumn("n_best", F.coalesce("n_best", F.lit(0))).withColumn("count_sum", F.coalesce("count_sum", F.lit(0)))


def registered_vocabularies() -> tuple[str, str, str]:
    """Paths of A's ranks, the pattern of its pre-tokenizer, and B's model."""
    import public_tokenizers

    return public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)


def op11_align(spark, sf_dir):
    """The alignment of every document, its groups as a digest, scored by the links of the whole corpus."""
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *registered_vocabularies())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = aligned.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "pair_links")
    rows = materialize(rows, "aligned")
    return score(rows, lexicon(rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
