"""Near duplicates among vectors of one label by a tiled comparison in PCA order.

Unit vectors are turned so that their first dimensions vary most. For two of them the product of the
leading dimensions plus the product of the norms of the rest is at least their cosine, so a pair is given up
as soon as that bound is below the threshold; few pairs outlive the first dimensions. What is left is
compared in double precision. The result is exact: the turn decides only when a pair is given up.

Vectors of a label are sorted along the first dimension and cut into blocks of bounded size. Pairs of
blocks whose boxes in the leading dimensions are too far apart are never formed; the others are the tiles,
each compared in one task. A tile returns, for each vector, how many vectors it is linked to and one link
towards the smallest vector it reaches, never the pairs. Equal vectors of a label are one node.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize
from .components import connected_components

THRESHOLD = 0.98
#: Vectors of one block, and of the squares in which a task compares two blocks.
BLOCK, SQUARE = 8192, 1024
#: Dimensions after which pairs are given up, and those of a block's box.
STAGES = (8, 16, 32)
BOX = 8
#: What single precision may lose in a bound.
SLACK = 1e-5
#: Pairs that are finished at once.
PAIRS = 1 << 16


def _unit(data: bytes, count: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their norms, in double precision, from equally long byte strings of ``kind`` components laid end to end."""
    raw = np.frombuffer(data, kind).reshape(count, -1).astype(np.float64)
    scale = np.abs(raw).max(1, initial=0, keepdims=True)  # so that squares neither overflow nor vanish
    raw = raw / scale
    return raw, np.sqrt(np.einsum("ij,ij->i", raw, raw))


def nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame, str]:
    """``rows (id, label, key)`` of all rows, ``nodes (node, label, size, key, first, n, data)`` of the different vectors, and the kind of component.

    ``key`` is null where a row links with nothing. ``first`` is a node's smallest id, ``n`` its rows.
    """
    spark_kinds = dict(vectors.dtypes)
    kind = "<f4" if spark_kinds[vector_col] == "array<float>" else "<f8"
    array = "array<float>" if kind == "<f4" else "array<double>"
    vector = F.col(f"`{vector_col}`").cast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            # Adding zero makes -0.0 and 0.0 one.
            raw = (batch.column(2).flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind).tobytes()
            stops = (int(kind[2]) * np.cumsum(sizes)).tolist()
            data = list(map(raw.__getitem__, map(slice, [0, *stops], stops)))
            keys = [hashlib.md5(d).digest() for d in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "label", "size", "key", "data"])

    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    valid = F.coalesce(real & F.col(f"`{label_col}`").isNotNull(), F.lit(False))
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.when(valid, vector).otherwise(F.array().cast(array)).alias("vector"))
    schema = f"id {spark_kinds[id_col]}, label {spark_kinds[label_col]}, size int, key binary, data binary"
    rows = source.mapInArrow(run, schema)
    found = materialize(rows, "vectors")
    distinct = found.filter("size > 0").groupBy("label", "size", "key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("data").alias("data"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return found.select("id", "label", F.when(F.col("size") > 0, F.col("key")).alias("key")), distinct, kind


def axes(found: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes (columns, largest variance first) of all of them.

    Sums and products are added up in a task and shuffled by position, so a length's square of numbers is
    what reaches the driver, whatever the number of vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                data = batch.column(1).filter(pa.array(sizes == size)).to_pylist()
                raw, norms = _unit(b"".join(data), len(data), kind)
                one = np.concatenate([raw / norms[:, None], np.ones((len(raw), 1))], axis=1)
                sums[size] = sums.get(size, 0) + one.T @ one
        for size, total in sums.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(total.size, size, np.int32)), "at": pa.array(np.arange(total.size)), "x": pa.array(total.ravel())})

    parts = found.select("size", "data").mapInArrow(run, "size int, at bigint, x double").groupBy("size", "at").agg(F.sum("x").alias("x"))
    out = {}
    for size, group in parts.toPandas().groupby("size"):
        total = np.zeros((size + 1) ** 2)
        total[group["at"].to_numpy()] = group["x"].to_numpy()
        total = total.reshape(size + 1, size + 1)
        mean = total[-1, :-1] / total[-1, -1]
        out[size] = np.linalg.eigh(total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean))[1][:, ::-1]
    return out


def blocks(found: DataFrame, turns: dict[int, np.ndarray], kind: str) -> DataFrame:
    """``nodes`` with ``block`` and ``lead``, the leading dimensions: at most ``BLOCK`` neighbours along the first dimension share a block.

    Rows are sorted across partitions by label, length and first dimension; a block is a stretch of one
    partition, so it needs no window over a label.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = batch.column(2).to_numpy(), [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                raw, norms = _unit(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), len(at), kind)
                for i, values in zip(at.tolist(), (raw @ turns[size][:, :BOX] / norms[:, None]).tolist()):
                    out[i] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "lead"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, last = (TaskContext.get().partitionId() << 32) - 1, BLOCK, None
        for batch in batches:
            labels, sizes, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for here in zip(labels, sizes):
                if held == BLOCK or here != last:
                    block, held, last = block + 1, 0, here
                held += 1
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "block"])

    kinds = dict(found.dtypes)
    schema = f"node bigint, label {kinds['label']}, size int, n bigint, data binary, lead array<double>"
    led = materialize(found.select("node", "label", "size", "n", "data").mapInArrow(lead, schema), "led")
    parts = max(1, -(-led.count() // (2 * BLOCK)))
    ordered = led.repartitionByRange(parts, "label", "size", F.col("lead")[0]).sortWithinPartitions("label", "size", F.col("lead")[0])
    return materialize(ordered.mapInArrow(cut, schema + ", block bigint"), "blocks")


def tiles(cut: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(low, high)`` of blocks of one label and length whose boxes aren't farther apart than linked vectors can be.

    Blocks meet in the bins of the first dimension that their stretches touch, so blocks far apart there are
    not even compared; a pair is taken in its first common bin alone.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    width = max(reach, 1e-3)
    ends = [F.min(F.try_element_at("lead", F.lit(i + 1))).alias(f"min{i}") for i in range(BOX)] + [F.max(F.try_element_at("lead", F.lit(i + 1))).alias(f"max{i}") for i in range(BOX)]
    boxes = materialize(cut.groupBy("label", "size", "block").agg(*ends), "boxes")

    def bin_of(x: Column) -> Column:
        return F.floor(x / width)

    binned = boxes.withColumn("bin", F.explode(F.sequence(bin_of(F.col("min0")), bin_of(F.col("max0") + reach))))
    one, two = binned.alias("one"), binned.alias("two")
    same = (F.col("one.label") == F.col("two.label")) & (F.col("one.size") == F.col("two.size")) & (F.col("one.bin") == F.col("two.bin")) & (F.col("one.block") <= F.col("two.block"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"one.min{i}") - F.col(f"two.max{i}"), F.col(f"two.min{i}") - F.col(f"one.max{i}")) for i in range(BOX)]
    apart = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps[1:]), gaps[0] * gaps[0])
    first = bin_of(F.greatest("one.min0", "two.min0"))
    met = one.join(two, same & (F.col("one.bin") == first) & (apart <= reach * reach))
    return met.select(F.col("one.block").alias("low"), F.col("two.block").alias("high"))


class Turned:
    """Vectors in PCA order: single precision for bounds, the given ones for cosines."""

    def __init__(self, data: list[bytes], turn: np.ndarray, kind: str):
        self.raw, self.norms = _unit(b"".join(data), len(data), kind)
        unit = (self.raw / self.norms[:, None]) @ turn
        size = unit.shape[1]
        self.stops = [s for s in STAGES if s < size] + [size]
        self.unit = unit.astype(np.float32)
        after = np.cumsum((unit * unit)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(after[:, s] if s < size else np.zeros(len(unit))).astype(np.float32) for s in self.stops]
        # The first stage's bound as one product: the norm of the rest is one more dimension.
        self.first = np.concatenate([self.unit[:, : self.stops[0]], self.rest[0][:, None]], axis=1)


def links(one: Turned, two: Turned, threshold: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of ``one`` and ``two`` whose cosine reaches ``threshold``, in bounded pieces; with ``upper`` those i < j alone."""
    for i in range(0, len(one.raw), SQUARE):
        for j in range(i if upper else 0, len(two.raw), SQUARE):
            bound = one.first[i : i + SQUARE] @ two.first[j : j + SQUARE].T
            u, v = np.nonzero(bound >= threshold - SLACK)
            u, v = u + i, v + j
            if upper and i == j:
                u, v = u[u < v], v[u < v]
            for k in range(0, len(u), PAIRS):
                found = _finish(one, two, u[k : k + PAIRS], v[k : k + PAIRS], threshold)
                if len(found[0]):
                    yield found


def _finish(one: Turned, two: Turned, u: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    start, so_far = 0, np.zeros(len(u), np.float32)
    for stop, rest_one, rest_two in zip(one.stops, one.rest, two.rest):
        so_far = so_far + np.einsum("ij,ij->i", one.unit[u, start:stop], two.unit[v, start:stop])
        alive = so_far + rest_one[u] * rest_two[v] >= threshold - SLACK
        u, v, so_far, start = u[alive], v[alive], so_far[alive], stop
    near = np.einsum("ij,ij->i", one.raw[u], two.raw[v]) / (one.norms[u] * two.norms[v]) >= threshold
    return u[near], v[near]


def compare(cut: DataFrame, turns: dict[int, np.ndarray], kind: str, threshold: float) -> DataFrame:
    """``(node, links, root)``: by tile, the rows that a node is linked to and the smallest node it reaches within the tile."""
    pairs = materialize(tiles(cut, threshold), "tiles")
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("__block"))
    placed = cut.select("block", "node", "size", "n", "data").join(broadcast_within(sides, 200_000), F.col("block") == F.col("__block"))

    def run(tile: pa.Table) -> pa.Table:
        low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
        block, nodes, n = (tile.column(c).to_numpy() for c in ("block", "node", "n"))
        turn = turns[tile.column("size")[0].as_py()]
        at = np.flatnonzero(block == low), np.flatnonzero(block == high)
        one = Turned(tile.column("data").take(pa.array(at[0])).to_pylist(), turn, kind)
        two = one if low == high else Turned(tile.column("data").take(pa.array(at[1])).to_pylist(), turn, kind)
        count = np.zeros(len(nodes), np.int64)
        rank = np.argsort(np.argsort(nodes))  # positions in order of nodes
        root = np.arange(len(nodes))
        for u, v in links(one, two, threshold, low == high):
            u, v = at[0][u], at[1][v]
            np.add.at(count, u, n[v])
            np.add.at(count, v, n[u])
            join(root, rank[u], rank[v])
        linked = np.flatnonzero(count)
        return pa.table({"node": nodes[linked], "links": count[linked], "root": np.sort(nodes)[root[rank[linked]]]})

    return placed.groupBy("low", "high").applyInArrow(run, "node bigint, links bigint, root bigint")


def join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of ``u`` and ``v`` in ``root``, where each position points to its class's smallest."""
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while True:
            onward = root[root]
            if np.array_equal(onward, root):
                break
            root[:] = onward


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    Rows of one label (and length) are linked where the cosine of their vectors, in double precision, is at
    least ``threshold``. ``n_links`` counts the other rows that a row is linked to, ``component_id`` is the
    smallest id reachable over links, the row's own included, and ``kept`` says whether it is the row's own.
    A vector that is null, zero, empty or holds null or non-finite components, and any of a null label, links
    with nothing. Equal vectors of a label are linked, repeated rows too. A row without id is carried along
    and has a null component, and ``kept`` false, only if all it reaches have none. Any number of rows may
    share a label or a vector; an empty table gives no rows.
    """
    rows, found, kind = nodes(vectors, id_col, vector_col, label_col)
    turns = axes(found, kind)
    cut = blocks(found, turns, kind)
    near = materialize(compare(cut, turns, kind, threshold), "near")
    counts = near.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(near.select(F.col("node").alias("u"), F.col("root").alias("v")))
    members = found.select("node", "label", "key", "first", "n")
    rooted = materialize(members.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).select("node", "root", "first"), "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("smallest")), "smallest")
    reached = rooted.join(smallest, "root").select(F.col("node").alias("__r"), "smallest")
    classes = members.join(counts.withColumnRenamed("node", "__c"), F.col("node") == F.col("__c"), "left").join(reached, F.col("node") == F.col("__r"), "left")
    more = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    classes = classes.select(F.col("label").alias("__label"), F.col("key").alias("__key"), more, F.coalesce("smallest", "first").alias("component_id"))
    classes = materialize(classes.filter("n_links > 0"), "classes")
    out = rows.join(broadcast_within(classes, 200_000), (F.col("label") == F.col("__label")) & (F.col("key") == F.col("__key")), "left")
    component = F.when(F.col("__key").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` with the smallest id of each component alone; all columns stay, rows without id too."""
    from .common import without_ids

    found = near_duplicates(vectors, id_col, vector_col, label_col, threshold)
    losers = materialize(found.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct(), "losers")
    return without_ids(vectors, losers, id_col)


def op12_embedding_dedup(spark, sf_dir):
    """Links and component of every vector among those of its label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = f"""
WITH RECURSIVE ok AS MATERIALIZED (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS v FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {THRESHOLD}
), reach AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings
    UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), found AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN found ON vec_id = found.u LEFT JOIN counts ON vec_id = counts.u
"""
