"""Best-fit sequence packing by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

CAPACITY = 1024
END_ID = 2
#: The vocabulary; its ranks file gives the same ids, and the added tokens are read from the first.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces that one population packs on average, populations for the same pieces, and their settings.
SHARD = 16384
ISLANDS = 2
POPULATION = 3
GENERATIONS = 8
EPOCHS = 2
#: Largest share of a donor's bins, best filled first, that a crossover injects, and of its own emptiest bins that it opens.
INJECTED, OPENED = 0.5, 0.1
#: Sizes that are tried as the largest of three items that fill a room.
TRIED = 40
#: Words in one generation of an encoder's memory.
_CACHE = 200_000
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", "\n ", " \n", "\n\n")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, with a bounded memory of encoded words.

    No token of the vocabulary's pre-tokenizer reaches from a non-space into a following space, so a
    text cut before each space or line break that stands between non-spaces has the tokens of its parts
    in order. Most parts are words met before. Texts with other white space, or with several white
    spaces in a row, are encoded in one. Of the words met, those of the last two generations are known.
    An added token (``added``, by its text) stands for itself wherever its text occurs, the longest first,
    and what is between is encoded as texts of their own.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.added = {text: array("I", [number]).tobytes() for text, number in (added or {}).items()}
        self.cuts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.tokens = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: By the word that follows a space, or by a part that starts with a line break.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokens(text)).tobytes()

    def with_added(self, text: str) -> bytes | None:
        """The ids of a text that holds an added token; None for any other text."""
        if self.cuts is None or not self.cuts.search(text):
            return None
        out, at = [], 0
        for found in self.cuts.finditer(text):
            out += [self.whole(text[at : found.start()]), self.added[found.group(0)]]
            at = found.end()
        return b"".join([*out, self.whole(text[at:])])

    def _learn(self, word: str) -> bytes:
        """The ids of a space and ``word``, in which single line breaks may stand between non-spaces.

        Letters and the marks after them never share a token, so each side is looked up by itself.
        """
        found = self.known.get(word)
        if found is None:
            base = word.rstrip(".,!%*&$#")
            if "\n" in word:
                first, line = word.rsplit("\n", 1)
                found = self._learn(first) + self._learn("\n" + line) if first else self.whole(word)
            elif len(base) == len(word) or not base.isalpha():
                found = array("I", self.tokens(" " + word)).tobytes()
            else:
                marks = word[len(base) :]
                found = self._learn(base) + (self.marks.get(marks) or self.marks.setdefault(marks, self.whole(marks)))
            self.known[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i: ids for i, ids in enumerate(map(self.with_added, texts)) if ids is not None}
        split = [None if i in special or _ODD.search(t) or any(x in t for x in _RUNS) or t[:1] in " \n" or t[-1:] in " \n" else t.split(" ") for i, t in enumerate(texts)]
        if len(self.known) > _CACHE:
            self.known, self.older, self.marks = {}, self.known, {}
        words = set().union(*[s[1:] for s in split if s])
        words -= self.known.keys()
        again = words & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        for word in words - again:
            self._learn(word)
        look = self.known.__getitem__
        return [special[i] if i in special else self.whole(t) if s is None else self.whole(s[0]) + b"".join(map(look, s[1:])) for i, (t, s) in enumerate(zip(texts, split))]


def pieces(docs: DataFrame, vocabulary: str, pattern: str, added: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32`` for each piece of at most ``capacity`` ids.

    A document is the ids of its whole text and then ``END_ID``. Only longer documents are cut: the
    first piece takes what is left over from full ones. ``uid`` differs for every piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern, added)
        end = np.array([END_ID], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i in range(0, len(texts), 256):
                for doc, data in zip(ids[i : i + 256], encoder.encode(texts[i : i + 256])):
                    data += end
                    total = len(data) // 4
                    start, piece = 0, 0
                    size = total if total <= capacity else total % capacity or capacity
                    while start < total:
                        rows.append((uid, doc, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
                        start, piece, size, uid = start + size, piece + 1, capacity, uid + 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Bins under a best-fit rule: the open bins are filed by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room, self.mask = capacity, [], [[] for _ in range(capacity + 1)], 0

    def open(self, room: int) -> int:
        self.rooms.append(room)
        self._file(len(self.rooms) - 1, room)
        return len(self.rooms) - 1

    def _file(self, at: int, room: int) -> None:
        if room:
            self.by_room[room].append(at)
            self.mask |= 1 << room

    def place(self, size: int) -> int:
        """The bin with least room that still takes ``size``; a new one if there is none."""
        fits = self.mask >> size
        if not fits:
            return self.open(self.capacity - size)
        room = size + (fits & -fits).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.rooms[at] = room - size
        self._file(at, room - size)
        return at


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item when they are placed best fit in ``order``."""
    bins, out = Bins(capacity), np.empty(len(sizes), np.int32)
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        out[item] = bins.place(size)
    return out


class Pool:
    """Displaced items by size, the sizes present as the bits of one number."""

    def __init__(self, sizes: list[int], items: list[int], capacity: int):
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.mask, self.mirrored = capacity, 0, 0
        for item in items:
            self.put(item, sizes[item])

    def put(self, item: int, size: int) -> None:
        self.by_size[size].append(item)
        self.mask |= 1 << size
        self.mirrored |= 1 << (self.capacity - size)

    def take(self, size: int) -> int:
        item = self.by_size[size].pop()
        if not self.by_size[size]:
            self.mask &= ~(1 << size)
            self.mirrored &= ~(1 << (self.capacity - size))
        return item

    def largest(self, size: int) -> int:
        """The greatest size present that is at most ``size``, or less than 1."""
        return (self.mask & ((2 << size) - 1)).bit_length() - 1


    def exact(self, room: int) -> tuple[int, ...]:
        """One, two or three sizes present that add up to ``room``, larger ones first; nothing if there are none.

        Bit b of the mask and of the mirrored mask shifted by the room are both set where b and its
        complement are present, so all pairs are tried at once.
        """
        if self.mask >> room & 1:
            return (room,)
        pairs = self._pair(room)
        if pairs:
            return pairs
        first = self.largest(room)
        for _ in range(TRIED):
            if first < 1:
                break
            rest = self._pair(room - first)
            if rest and len(self.by_size[first]) > rest.count(first):
                return (first, *rest)
            first = self.largest(first - 1)
        return ()

    def _pair(self, room: int) -> tuple[int, ...]:
        both = self.mask & (self.mirrored >> (self.capacity - room)) & ((1 << room) - 1)
        while both > 1:
            size = both.bit_length() - 1
            if 2 * size != room or len(self.by_size[size]) > 1:
                return size, room - size
            both &= ~(1 << size)
        return ()


def exact_fill(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item when the largest item left is joined by one, two or three that fill its bin exactly.

    Larger items are taken first, so that small ones are left for where they are needed; a bin that
    can't be filled exactly takes the largest items that fit. Items of one size come in ``order``.
    """
    size_of = sizes.tolist()
    pool = Pool(size_of, order.tolist(), capacity)
    out = np.empty(len(sizes), np.int32)
    number = 0
    while pool.mask:
        size = pool.mask.bit_length() - 1
        out[pool.take(size)] = number
        room = capacity - size
        while room:
            chosen = pool.exact(room)
            if not chosen:
                size = pool.largest(room)
                chosen = (size,) if size > 0 else ()
            if not chosen:
                break
            for size in chosen:
                out[pool.take(size)] = number
                room -= size
        number += 1
    return out


def fitness(sizes: np.ndarray, assigned: np.ndarray, capacity: int) -> float:
    """Fewer bins first; among equals, bins filled more unevenly (mean squared fill)."""
    fill = np.bincount(assigned, sizes) / capacity
    return -float(len(fill)) + float(np.square(fill).mean())


def replace_dominated(sizes: list[int], bins: list[list[int]], rooms: list[int], pool: Pool) -> None:
    """Fill bins that have room: add a displaced item, or exchange one of their items for a larger one that still fits.

    Bins get fuller and what is displaced gets smaller and thus easier to place; ends when nothing changes.
    """
    open_bins = [at for at, room in enumerate(rooms) if room]
    while open_bins and pool.mask:
        changed = []
        for at in open_bins:
            room, members, before = rooms[at], bins[at], rooms[at]
            size = pool.largest(room)
            while size > 0:
                members.append(pool.take(size))
                room -= size
                size = pool.largest(room)
            for i, item in enumerate(members):
                if not room:
                    break
                own = sizes[item]
                size = pool.largest(own + room)
                if size > own:
                    members[i] = pool.take(size)
                    pool.put(item, own)
                    room -= size - own
            if room != before:
                rooms[at] = room
                if room:
                    changed.append(at)
        open_bins = changed


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``mother`` with whole well-filled bins of ``father``.

    Bins of the mother that hold an injected item are removed, so that no item is twice there, and so
    are some of her emptiest bins. Displaced items first replace smaller ones in bins with room; what
    is displaced in the end is placed best fit, largest first.
    """
    fill = np.bincount(father, sizes)
    best = np.argsort(-(fill + rng.random(len(fill)) * 0.02 * capacity), kind="stable")
    chosen = np.zeros(len(fill), bool)
    chosen[best[: max(1, int(len(best) * INJECTED * rng.random()))]] = True
    injected = chosen[father]
    own = np.bincount(mother, sizes)
    broken = np.zeros(len(own), bool)
    broken[mother[injected]] = True
    broken[np.argsort(own + rng.random(len(own)) * 0.01 * capacity, kind="stable")[: 2 + int(len(own) * OPENED * rng.random())]] = True
    stays = ~broken[mother] & ~injected
    placed = np.where(injected, father + len(broken), np.where(stays, mother, -1))
    kept, at = np.unique(placed[placed >= 0], return_inverse=True)
    order = np.argsort(at, kind="stable")
    items = np.flatnonzero(placed >= 0)[order]
    counts = np.bincount(at, minlength=len(kept))
    bins = [b.tolist() for b in np.split(items, np.cumsum(counts)[:-1])] if len(kept) else []
    rooms = (capacity - np.bincount(at, sizes[placed >= 0], len(kept)).astype(np.int64)).tolist()
    size_of = sizes.tolist()
    pool = Pool(size_of, rng.permutation(np.flatnonzero(placed < 0)).tolist(), capacity)
    replace_dominated(size_of, bins, rooms, pool)
    child = np.empty(len(sizes), np.int32)
    for number, members in enumerate(bins):
        child[members] = number
    rest = Bins(capacity)
    for room in rooms:
        rest.open(room)
    while pool.mask:
        size = pool.mask.bit_length() - 1
        child[pool.take(size)] = rest.place(size)
    return child


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """Members from best fit and exact fill, then ``GENERATIONS`` crossovers; a child better than the worst member replaces it. Best first."""
    rng = np.random.default_rng(seed)
    least = int(np.ceil(sizes.sum() / capacity))
    while len(population) < POPULATION:
        noise = rng.random(len(sizes)) * 0.05 * capacity * (len(population) > 1)
        order = np.argsort(-(sizes + noise), kind="stable")
        population.append((best_fit if len(population) != 1 else exact_fill)(sizes, order, capacity))
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(population)), key=lambda s: (-s[0], s[1]))[:POPULATION]
    for step in range(GENERATIONS):
        if int(scored[0][2].max()) + 1 <= least or len(scored) < 2:
            break
        mother, father = rng.choice(len(scored), 2, replace=False)
        child = crossover(sizes, scored[mother][2], scored[father][2], capacity, rng)
        scored = sorted([*scored, (fitness(sizes, child, capacity), POPULATION + step, child)], key=lambda s: (-s[0], s[1]))[:POPULATION]
    return [s[2] for s in scored]


def _epoch(population: DataFrame, capacity: int, epoch: int, tasks: int) -> DataFrame:
    """One epoch of every island: its members evolve; ``rank`` 0 is its elite.

    Rows are few and work is much, so the number of tasks follows the number of islands, not of bytes.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(table["shard"].iloc[0]), int(table["island"].iloc[0])
        sizes = np.asarray(table["sizes"].iloc[0], np.int64)
        start = [np.asarray(a, np.int32) for a in table["assigned"] if a is not None and len(a)]
        members = evolve(sizes, start, capacity, seed=(shard * ISLANDS + island) * 100 + epoch)
        return pd.DataFrame({"shard": shard, "island": island, "rank": range(len(members)), "score": [fitness(sizes, m, capacity) for m in members], "sizes": [sizes] * len(members), "assigned": members})

    return population.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(run, "shard long, island int, rank int, score double, sizes array<long>, assigned array<int>")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``uid, sequence_id, offset`` for ``items`` (``uid`` unique, ``length`` from 1 to ``capacity``).

    Full pieces are sequences by themselves. The others are dealt by a hash of their uid into shards
    of about ``SHARD``; each shard is evolved on ``ISLANDS`` islands that send their elite round a ring
    after every epoch but the last, and the best member of all islands is kept. ``items`` must be a
    written table. An empty table gives no rows.
    """
    loose = items.filter(F.col("length") < capacity)
    shards = max(1, -(-loose.count() // SHARD))
    dealt = loose.groupBy(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("length", "uid"))).alias("items"))
    packs = materialize(dealt, "shards")
    sizes = packs.select("shard", F.col("items.length").alias("sizes"))
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    population = sizes.withColumn("island", islands).withColumn("assigned", F.lit(None).cast("array<int>"))
    for epoch in range(EPOCHS):
        evolved = materialize(_epoch(population, capacity, epoch, -(-shards * ISLANDS // 2)), "islands")
        movers = evolved.filter("rank = 0").withColumn("island", (F.col("island") + 1) % ISLANDS)
        population = evolved.unionByName(movers).select("shard", "island", "sizes", "assigned")
    best = evolved.groupBy("shard").agg(F.max_by("assigned", F.struct("score", -F.col("island"), -F.col("rank"))).alias("assigned"))

    placed = packs.join(best, "shard").select("shard", F.explode(F.arrays_zip(F.col("items.uid").alias("uid"), F.col("items.length").alias("length"), F.col("assigned").alias("bin"))).alias("x"))
    placed = placed.select(F.col("x.uid").alias("uid"), F.col("x.length").alias("length"), (F.shiftleft("shard", 24) + F.col("x.bin")).alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity rows
    offsets = placed.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")).alias("offset"))
    full = items.filter(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return offsets.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, added: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its offset in it.

    Null and empty texts are one piece of the end id alone. Repeated rows and rows without id are
    packed like any other. Only the id and text columns are read. An empty table gives no rows.
    """
    cut = materialize(pieces(docs, vocabulary, pattern, added, id_col, text_col), "pieces")
    placed = pack(cut.select("uid", "length"))
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def registered_vocabulary() -> tuple[str, str, dict[str, int]]:
    """Path of the ranks file, the pattern of its pre-tokenizer, and the vocabulary's added tokens."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN, added


def op5_pack(spark, sf_dir):
    """Every piece of every document, packed with the production settings."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *registered_vocabulary())
