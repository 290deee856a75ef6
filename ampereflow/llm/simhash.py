"""SimHash near duplicates: positional byte index, count filter, verification, components.

A document's fingerprint has 64 bits, eight bytes in fixed positions. Two fingerprints that differ in
at most ``MAX_BITS`` (four) bits differ in at most four bytes, so at least ``MIN_SHARED`` (four) of
their positional bytes are equal: the guaranteed minimum of matches.

Lists of single positional bytes would each hold a 256th of all fingerprints, and tallying their pairs
is quadratic. So the lists are keyed by each choice of four positions with its four bytes: a pair is in
a common list if and only if its tally of shared positional bytes reaches the minimum, and no other
pair is ever formed. The tally itself is taken for each pair of a list before the bits are compared.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, text_or_empty, without_ids
from .components import connected_components

WORDS = 4
MAX_BITS = 4
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
SEED = 42
#: Fingerprints of one list that a task links at once; longer lists are split into pairs of such blocks.
BLOCK = 4096


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of one text, as a signed integer; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = ends - np.fromiter(map(len, words), np.int64, len(words))
    span = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for each row, ``fp`` the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def _index(distinct: DataFrame) -> DataFrame:
    """``(slot, key, fp)``: the 70 lists of each fingerprint, one for each choice of four positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = list(combinations(range(BYTES), MIN_SHARED))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 1024):
                part = fps[i : i + 1024]
                as_bytes = part.astype(">i8").view(np.uint8).reshape(-1, BYTES)
                keys = np.concatenate([np.ascontiguousarray(as_bytes[:, c]).view(">i4").ravel().astype(np.int32) for c in choices])
                slots = np.repeat(np.arange(len(choices), dtype=np.int8), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(keys), pa.array(np.tile(part, len(choices)))], names=["slot", "key", "fp"])

    return distinct.mapInArrow(run, "slot tinyint, key int, fp bigint")


def link(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one list, or of the two blocks ``left`` and ``right`` together.

    Breadth first: each fingerprint taken from the queue is compared with those not reached yet, its
    tally of shared bytes and then its bits are checked, and what it reaches is linked and queued. Every
    fingerprint is reached once, so a list gives fewer links than it has members, and a dense list
    needs few comparisons.
    """
    values = left if right is None else np.concatenate([left, right])
    rest, out_a, out_b = values.view(np.uint64), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            differ = rest ^ at
            shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            near = (shared >= MIN_SHARED) & (np.bitwise_count(differ) <= MAX_BITS)
            if near.any():
                found, rest = rest[near], rest[~near]
                out_a.append(np.full(len(found), at, np.uint64))
                out_b.append(found)
                queue.extend(found)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each list of a partition sorted by (slot, key, fp).

    A row ``(u, v, slot, key, block)`` is a link where ``block`` is null. A list of more than
    ``BLOCK`` members is passed on instead, cut into blocks: ``u`` is then a member.
    """
    names = ["u", "v", "slot", "key", "block"]

    def rows(u, v, slot=None, key=None, block=None):
        n = len(u)
        fill = [pa.nulls(n, t) if x is None else pa.array(np.full(n, x), t) for x, t in ((slot, pa.int8()), (key, pa.int32()), (block, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *fill], names=names)

    held: list[np.ndarray] = []
    held_key: tuple[int, int] | None = None
    passed = 0

    def close():
        nonlocal held, passed
        members = np.concatenate(held) if held else np.empty(0, np.int64)
        held = []
        if passed:
            if len(members):
                yield rows(members, members, *held_key, passed)
        elif len(members) > 1:
            u, v = link(members)
            if len(u):
                yield rows(u, v)
        passed = 0

    for batch in batches:
        slot, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(fp)]])
        sizes = np.diff(bounds)
        last = len(sizes) - 1
        for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last)).tolist():
            here = (int(slot[bounds[i]]), int(key[bounds[i]]))
            if here != held_key:
                yield from close()
                held_key = here
            held.append(fp[bounds[i] : bounds[i + 1]])
            while sum(map(len, held)) > BLOCK:
                members = np.concatenate(held)
                yield rows(members[:BLOCK], members[:BLOCK], *here, passed)
                held, passed = [members[BLOCK:]], passed + 1
    yield from close()


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Links within long lists: every pair of a list's blocks is one group of at most two blocks."""
    counts = blocks.groupBy("slot", "key").agg((F.max("block") + 1).alias("blocks"))
    last = F.greatest(F.col("blocks") - 1, F.lit(1))
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    paired = blocks.join(counts, ["slot", "key"]).select("slot", "key", "u", "block", other).filter("block <> other")
    paired = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(table: pa.Table) -> pa.Table:
        u, v = link(table.column("u").to_numpy())
        return pa.table({"u": u, "v": v})

    return paired.groupBy("slot", "key", "low", "high").applyInArrow(run, "u bigint, v bigint")


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints whose components are those of all links of at
    most ``MAX_BITS`` differing bits. ``distinct``: one column, each fingerprint once."""
    index = _index(distinct).repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")
    found = materialize(index.mapInArrow(_lists, "u bigint, v bigint, slot tinyint, key int, block int"), "near")
    links = found.filter("block is null").select("u", "v")
    if found.filter("block is not null").limit(1).count():
        links = links.union(_block_pairs(found.filter("block is not null")))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row of ``docs``.

    Rows of one fingerprint are one node, held by their smallest id, so groups of copies are never
    paired up. ``component_id`` is the smallest id reachable over links of at most ``MAX_BITS``
    differing bits, a row's own id included. Null and empty texts have fingerprint zero, which is
    linked like any other. Null ids are carried along and never become a component's id unless all ids
    of the component are null. An empty table gives no rows. Minima are aggregated and written before
    they are joined, so that Spark can split the join of a hot fingerprint or component.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = materialize(connected_components(near_links(nodes.select("fp"))), "roots")
    linked = materialize(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first"), "linked")
    smallest = materialize(linked.groupBy("root").agg(F.min("first").alias("smallest")), "smallest")
    found = linked.join(smallest, "root").select(F.col("fp").alias("__linked"), "smallest", F.lit(True).alias("__in"))
    component = F.when(F.col("__in"), F.col("smallest")).otherwise(F.col("first"))
    classes = materialize(nodes.join(found, F.col("fp") == F.col("__linked"), "left").select(F.col("fp").alias("__fp"), component.alias("component_id")), "classes")
    out = marked.join(classes, F.col("fp") == F.col("__fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component alone; all columns stay, rows without id too."""
    found = near_duplicates(docs, id_col, text_col)
    losers = materialize(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "near-losers")
    return without_ids(docs, losers, id_col)


def op7_simhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
