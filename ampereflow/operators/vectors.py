"""Vector entries of document chunks: preparation, conflict checks, exact search."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConflictError, DependencyUnavailableError, InvalidRequestError
from ..functions.normalize import point_uuid
from ..schemas import stripped
from ..schemas import vector as is_vector
from ..shared import batches, broadcast_within, exists, materialize, publish

KEY = ("document_id", "chunk_id")
DISTANCES = ("cosine", "dot", "euclid", "manhattan")
#: Most keys of a call that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: A call of so many bytes at least, and a table of up to so many times its size, are grouped together.
LARGE_CALL, WHOLE_TABLE = 1 << 20, 4
#: Most partitions that the groups of a batch search are dealt over.
MOST_PARTITIONS = 8192
#: Spark estimates a table that it knows nothing of at least so large.
UNKNOWN = 1 << 60
_MADE_FOR = "_collection"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def score(distance: str, stored: Column, query: list[float]) -> Column:
    """Score of a stored vector; higher is nearer for cosine and dot, lower for the others."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    if distance == "dot":
        return _sum(F.zip_with(stored, asked, lambda a, b: a * b))
    if distance == "cosine":
        length = sum(float(x) ** 2 for x in query) ** 0.5
        own = F.sqrt(_sum(F.transform(stored, lambda a: a * a)))
        return F.try_divide(_sum(F.zip_with(stored, asked, lambda a, b: a * b)), own * length)
    if distance == "euclid":
        return F.sqrt(_sum(F.zip_with(stored, asked, lambda a, b: (a - b) * (a - b))))
    if distance == "manhattan":
        return _sum(F.zip_with(stored, asked, lambda a, b: F.abs(a - b)))
    raise InvalidRequestError("unknown distance")


def search(entries: DataFrame, query: list[float], limit: int, distance: str = "cosine", dimension: int | None = None, key: tuple[str, ...] = KEY, column: str = "vector") -> DataFrame:
    """The ``limit`` nearest entries with ``score`` and ``rank``, exactly; ties by key.

    Each task keeps its own best rows, so only ``limit`` rows of each are merged.
    """
    if limit < 1:
        raise InvalidRequestError("the limit must be positive")
    if dimension is not None and len(query) != dimension:
        raise InvalidRequestError("the query has another dimension")
    value = score(distance, F.col(column).cast("array<double>"), query)
    best = F.col("score").desc_nulls_last() if distance in ("cosine", "dot") else F.col("score").asc_nulls_last()
    nearest = entries.select(*key, value.alias("score")).orderBy(best, *key).limit(limit)
    return nearest.withColumn("rank", F.row_number().over(Window.orderBy(best, *key)))  # of at most limit rows


def _scores(distance: str, asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Scores of vectors against vectors of a shape that broadcasts, summed in the order of the dimensions (the last axis)."""
    if distance not in DISTANCES:
        raise InvalidRequestError("unknown distance")
    out = np.zeros(np.broadcast_shapes(asked.shape[:-1], stored.shape[:-1]))
    own, length = np.zeros(stored.shape[:-1]), np.zeros(asked.shape[:-1])
    for a, b in zip(np.moveaxis(asked, -1, 0), np.moveaxis(stored, -1, 0)):
        if distance in ("cosine", "dot"):
            out += a * b
            own, length = own + b * b, length + a * a
        else:
            step = b - a
            out += step * step if distance == "euclid" else np.abs(step)
    if distance == "euclid":
        return np.sqrt(out)
    if distance == "cosine":
        scale = np.sqrt(own) * np.sqrt(length)
        return np.divide(out, scale, out=np.full_like(out, np.nan), where=scale != 0)
    return out


def _tile(distance: str, asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Scores of each query (row) and stored vector (column)."""
    return _scores(distance, asked[:, None], stored[None])


def _city(asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Manhattan distances in single precision, in squares that stay in a core's cache."""
    out = np.zeros((len(asked), len(stored)), np.float32)
    one, other = asked.T.astype(np.float32), np.ascontiguousarray(stored.T, np.float32)
    for i in range(0, len(asked), 64):
        for j in range(0, len(stored), 1024):
            total = np.zeros_like(out[i : i + 64, j : j + 1024])
            step = np.empty_like(total)
            for a, b in zip(one[:, i : i + 64], other[:, j : j + 1024]):
                np.subtract(b, a[:, None], out=step)
                total += np.abs(step, out=step)
            out[i : i + 64, j : j + 1024] = total
    return out


def _about(distance: str, asked: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, slack)`` of each query and stored vector: about the score (squared for euclid, negated where higher is nearer) by
    fast means, and by how much it and what :func:`_scores` computes may differ at most. What can't be told is not a number."""
    unit = 8 * (asked.shape[1] + 8) * (2.0**-24 if distance == "manhattan" else 2.0**-53)
    if distance == "manhattan":
        size = np.abs(asked).sum(1)[:, None] + np.abs(stored).sum(1)
        return _city(asked, stored), np.where(size < 1e37, unit * size + 1e-30, np.inf)
    inner = asked @ stored.T
    one, other = (asked * asked).sum(1)[:, None], (stored * stored).sum(1)
    if distance == "euclid":
        return one + other - 2 * inner, unit * (one + other) + 1e-300
    scale = np.sqrt(one) * np.sqrt(other)
    if distance == "dot":
        return -inner, unit * scale + 1e-300
    sure = (np.minimum(one, other) > 1e-280) & (np.maximum(one, other) < 1e280)
    return np.divide(-inner, scale, out=np.full_like(inner, np.nan), where=sure), np.full_like(inner, unit)


def _best(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, limit: int, sign: float) -> np.ndarray:
    """Places of the ``limit`` best of each row's ``(ids, values)``, in order; ties by id, missing values last."""
    order = np.lexsort((ids, np.where(np.isnan(values), np.inf, sign * values), rows))
    firsts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
    return order[place < limit]


def _nearest_of_tile(asked_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, stored: np.ndarray, limit: int, distance: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query_id, id, score)`` of the ``limit`` best entries of each query of a tile, computed in squares of bounded size.

    Approximate scores with a bound of their error tell which pairs can't be among the best; all others are scored exactly.
    """
    sign = -1.0 if distance in ("cosine", "dot") else 1.0
    whole = ~np.isnan(stored).any(1)
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(asked), 256):
        part = asked[i : i + 256]
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        worst = np.full(len(part), np.inf)  # of a query's best so far, if these are as many as asked for
        for j in range(0, len(stored), 4096):
            square = stored[j : j + 4096]
            with np.errstate(all="ignore"):
                about, slack = _about(distance, part, square)
                most = worst * worst * (1 + 2.0**-40) if distance == "euclid" else worst
                if np.isinf(most).any() and len(square) > limit:
                    above = about + slack
                    above[np.isnan(above)] = np.inf
                    most = np.minimum(most, np.partition(above, limit - 1, axis=1)[:, limit - 1])
                near = ~(about > most[:, None] + slack)
            near &= whole[j : j + 4096] | np.isinf(most)[:, None]
            at = np.nonzero(near)
            for k in range(0, len(at[0]), 1 << 18):
                row, column = at[0][k : k + (1 << 18)], at[1][k : k + (1 << 18)]
                kept = tuple(np.concatenate(x) for x in zip(kept, (row, ids[j + column], _scores(distance, part[row], square[column]))))
                best = _best(*kept, limit, sign)
                kept = tuple(x[best] for x in kept)
            known = kept[0][~np.isnan(kept[2])]
            full = np.bincount(known, minlength=len(part)) >= limit
            high = np.full(len(part), -np.inf)
            np.maximum.at(high, known, sign * kept[2][~np.isnan(kept[2])])
            worst = np.where(full, high, np.inf)
        out.append((asked_ids[i + kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search_all(entries: DataFrame, queries: DataFrame, limit: int, distance: str = "cosine", id_col: str = "vec_id", column: str = "vector", block: int = 4096, tile: int = 8192) -> DataFrame:
    """``(query_id, id_col, score, rank)``: the ``limit`` nearest entries of every row of ``queries``, exactly; ties by id.

    Ids are whole numbers. Queries and entries are dealt by hash into blocks of about ``block`` and ``tile`` rows; each block of
    queries meets each block of entries in a group of its own, which keeps its best rows of each query, and those are merged. The
    number of partitions follows the number of groups, not their bytes, as a group's work is the product of its two sides. One plan for any number of queries; no vector reaches the driver. A vector that is
    null or of another dimension has a null score, which comes last; queries must have one dimension.
    """
    if limit < 1:
        raise InvalidRequestError("the limit must be positive")
    if distance not in DISTANCES:
        raise InvalidRequestError("unknown distance")
    shown = lambda rows: rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    asked = shown(queries)
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size("vector"), F.lit(-1))).alias("low"), F.max(F.coalesce(F.size("vector"), F.lit(-1))).alias("width")).first()
    if sizes.n and (sizes.low != sizes.width or sizes.low < 0):
        raise InvalidRequestError("the queries have different dimensions")
    width = sizes.width or 0
    fits = F.coalesce(F.size("vector") == width, F.lit(False))
    rows = shown(entries).withColumn("vector", F.when(fits, F.col("vector")).otherwise(F.array_repeat(F.lit(float("nan")), width)))
    query_blocks, entry_blocks = max(1, -(-sizes.n // block)), max(1, -(-rows.count() // tile))
    # Blocks by hash, so that a lost task's rows fall into the same blocks again.
    place = lambda count: F.pmod(F.xxhash64("id", "vector"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    one = asked.select(place(query_blocks).alias("query_block"), all_of(entry_blocks).alias("entry_block"), F.lit(True).alias("asked"), "id", "vector")
    two = rows.select(all_of(query_blocks).alias("query_block"), place(entry_blocks).alias("entry_block"), F.lit(False).alias("asked"), "id", "vector")

    def run(group: pa.Table) -> pa.Table:
        side, ids = group.column("asked").to_numpy(), group.column("id").to_numpy()
        values = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
        if side.all() or not side.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = _nearest_of_tile(ids[side], values[side], ids[~side], values[~side], limit, distance)
        return pa.table({"query_id": found[0], "id": found[1], "score": pa.array(found[2], mask=np.isnan(found[2]))})

    groups = one.unionByName(two).repartition(min(2 * query_blocks * entry_blocks, MOST_PARTITIONS), "query_block", "entry_block")
    found = groups.groupBy("query_block", "entry_block").applyInArrow(run, "query_id bigint, id bigint, score double")
    best = F.col("score").desc_nulls_last() if distance in ("cosine", "dot") else F.col("score").asc_nulls_last()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "id")))
    return ranked.filter(F.col("rank") <= limit).withColumnRenamed("id", id_col)


def prepare(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their vectors by id; strict callers compare counts with :func:`require_complete`."""
    return chunks.join(embeddings.select(*KEY, "vector"), list(KEY))


def require_complete(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> None:
    """Every chunk has exactly one vector of finite numbers and of the right dimension, and no other has."""
    joined = chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).join(embeddings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("e"), F.min(is_vector(F.col("vector")) & (F.size("vector") == dimension)).alias("good")), list(KEY), "full_outer")
    if joined.filter("not (c <=> e) or not coalesce(good, false)").limit(1).count():
        raise DependencyUnavailableError("embeddings do not match the chunks")


def fingerprinted(entries: DataFrame, *content: str) -> DataFrame:
    """Entries with ``fingerprint``, equal for equal contents."""
    return entries.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*KEY, *content), {"ignoreNullFields": "false"}), 256))


def _bytes(rows: DataFrame) -> int:
    """Spark's estimate of a table's size; no job is run for it."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _action(kept: Column) -> Column:
    """The action of a key from its call's and its stored contents; ``kept`` says whether it is stored."""
    mixed = ~F.col("__low").eqNullSafe(F.col("__high")) | ((F.col("__known") > 0) & (F.col("__known") < F.col("__n")))
    same = F.col("__stored").eqNullSafe(F.col("__low")) & F.col("__other").eqNullSafe(F.col("__low"))
    return F.when(mixed, "conflict").when(~kept, "insert").when(same, "skip").otherwise("conflict")


def _classify_together(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...], content: str) -> DataFrame:
    side = lambda rows, calls: rows.select(*key, F.col(content).alias("__content"), F.lit(calls).alias("__call"))
    call, there = F.col("__call"), ~F.col("__call")
    of = lambda which, value: F.when(which, value)
    own, held = of(call, F.col("__content")), of(there, F.col("__content"))
    sums = [F.min(own).alias("__low"), F.max(own).alias("__high"), F.count(of(call, F.lit(1))).alias("__n"), F.count(own).alias("__known"), F.min(held).alias("__stored"), F.max(held).alias("__other"), F.count(of(there, F.lit(1))).alias("__kept")]
    grouped = side(incoming, True).unionByName(side(stored, False)).groupBy(*key).agg(*sums)
    # Keys are joined by equality, so a key with a null is never stored.
    known = F.lit(True)
    for name in key:
        known = known & F.col(name).isNotNull()
    return grouped.filter("__n > 0").select(*key, _action((F.col("__kept") > 0) & known).alias("action"))


def classify(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...] = KEY, content: str = "fingerprint") -> DataFrame:
    """For each key that comes in: ``action`` ``insert``, ``skip`` or ``conflict``.

    Equal repeats within the call are one; different ones are a conflict, and so is a stored row of
    other content. For a call about as large as what is stored both sides are grouped together, in one shuffle. For a smaller one
    the keys of the call are aggregated and written first, and of the stored rows only
    those with such a key are grouped: a small call shuffles little of a large table.
    """
    size = _bytes(incoming)
    if LARGE_CALL <= size < UNKNOWN and _bytes(stored) <= WHOLE_TABLE * size:
        return _classify_together(incoming, stored, key, content)
    calls = incoming.groupBy(*key).agg(F.min(content).alias("__low"), F.max(content).alias("__high"), F.count(F.lit(1)).alias("__n"), F.count(content).alias("__known"))
    calls = materialize(calls, "calls")
    asked = broadcast_within(calls.select(*key), BROADCAST_KEYS)
    kept = stored.join(asked, list(key), "left_semi").groupBy(*key).agg(F.min(content).alias("__stored"), F.max(content).alias("__other"), F.lit(True).alias("__there"))
    return calls.join(kept, list(key), "left").select(*key, _action(F.col("__there").isNotNull()).alias("action"))


def require_stored(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...] = KEY, content: str = "fingerprint") -> None:
    """After a write: every row must be read back as it was; a missing one means that the store failed, a different one a conflict."""
    actions = {r.action for r in classify(incoming, stored, key, content).select("action").distinct().collect()}  # at most three
    if "conflict" in actions:
        raise ConflictError("a stored row differs from the written one")
    if "insert" in actions:
        raise DependencyUnavailableError("a written row can't be read back")


def index(incoming: DataFrame, path: str, dimension: int, *content: str) -> int:
    """Append new entries to the Parquet table at ``path``; the number of rows written.

    Any conflict or wrong dimension is raised before anything is written; equal entries are skipped. New entries are one
    batch: staged, read back and compared, and then moved into place together; a failure leaves the table as it was.
    """
    spark = incoming.sparkSession
    if incoming.filter(~is_vector(F.col("vector")) | (F.size("vector") != dimension)).limit(1).count():
        raise InvalidRequestError("an entry has another dimension")
    entries = fingerprinted(incoming, "vector", *content)
    stored = batches(spark, path, entries.schema).select(*KEY, "fingerprint")
    actions = materialize(classify(entries, stored), "actions")
    if actions.filter("action = 'conflict'").limit(1).count():
        raise ConflictError("an entry differs from the stored one")
    wanted = actions.filter("action = 'insert'").select(*KEY)
    count = wanted.count()
    if count:
        new = materialize(entries.join(broadcast_within(wanted, BROADCAST_KEYS), list(KEY), "left_semi").dropDuplicates(list(KEY)), "new")
        publish(new, path, lambda staged: require_stored(new, staged.select(*KEY, "fingerprint")))
    return count


def collection_status(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``name, status`` of the collections ``wanted (name, dimension, distance)`` among the ``existing`` ones.

    ``absent``, ``ready``, ``other_dimension`` or ``other_distance``; both must agree for a collection to be used.
    """
    held = existing.select("name", F.col("dimension").alias("__size"), F.col("distance").alias("__distance"))
    status = F.when(F.col("__size").isNull(), "absent").when(F.col("__size") != F.col("dimension"), "other_dimension").when(F.col("__distance") != F.col("distance"), "other_distance").otherwise("ready")
    return wanted.join(held, "name", "left").select("name", status.alias("status"))


def collection_state(spark: SparkSession, path: str, dimension: int, distance: str = "cosine") -> str:
    """``absent``, or ``ready`` if the collection at ``path`` was made for this dimension and distance; others are a conflict.

    What a collection is made for is a table of one row beside its entries, so no entry is read.
    """
    if not exists(spark, f"{path}/{_MADE_FOR}"):
        return "absent"
    wanted = spark.createDataFrame([(path, dimension, distance)], "name string, dimension int, distance string")
    status = collection_status(wanted, spark.read.parquet(f"{path}/{_MADE_FOR}").withColumn("name", F.lit(path))).first().status
    if status != "ready":
        raise ConflictError(f"the collection has an{status.replace('_', ' ')}" if status.startswith("other") else "the collection can't be read")
    return status


def ensure_collection(spark: SparkSession, path: str, dimension: int, distance: str = "cosine") -> bool:
    """Make the collection if it is absent, and verify it; whether it was made now."""
    if dimension < 1 or distance not in DISTANCES:
        raise InvalidRequestError("a collection needs a positive dimension and a known distance")
    made = collection_state(spark, path, dimension, distance) == "absent"
    if made:
        spark.createDataFrame([(dimension, distance)], "dimension int, distance string").coalesce(1).write.parquet(f"{path}/{_MADE_FOR}")
        collection_state(spark, path, dimension, distance)
    return made


#: The fields of a stored entry's payload.
PAYLOAD_KEYS = ("chunk_id", "content_sha256", "document_id", "ordinal", "page_number", "text")


def decode_payloads(points: DataFrame, namespace: uuid.UUID, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored ``points (id, payload)``, payload a JSON text, as fields, with ``problem`` where one can't be trusted.

    ``payload`` unless it is an object of exactly the known fields; ``type`` unless ids, text and digest are
    texts that are not blank, the ordinal a whole number from 0 and the page number null or a whole
    number from 1; ``digest`` unless that has 64 hexadecimal digits; ``id`` unless it is the UUID of the
    keys. The first of these counts. Fields of a bad payload are null. Columns in ``keep`` stay.
    """
    tree = F.try_parse_json("payload")
    kind = lambda name: F.schema_of_variant(F.try_variant_get("__tree", f"$.{name}", "variant"))
    text = lambda name: F.try_variant_get("__tree", f"$.{name}", "string")
    whole = lambda name: F.try_variant_get("__tree", f"$.{name}", "bigint")
    rows = points.withColumn("__tree", tree)
    keys = F.array_sort(F.json_object_keys("payload"))
    exact = F.coalesce(F.col("__tree").isNotNull() & (F.size(keys) == len(PAYLOAD_KEYS)) & (keys == F.array(*map(F.lit, PAYLOAD_KEYS))), F.lit(False))
    texts = F.lit(True)
    for name in ("chunk_id", "content_sha256", "document_id", "text"):
        texts = texts & F.coalesce((kind(name) == "STRING") & (stripped(text(name)) != ""), F.lit(False))
    numbers = F.coalesce((kind("ordinal") == "BIGINT") & (whole("ordinal") >= 0), F.lit(False)) & F.coalesce((kind("page_number") == "VOID") | ((kind("page_number") == "BIGINT") & (whole("page_number") >= 1)), F.lit(False))
    own = point_uuid(namespace, text("document_id"), text("chunk_id"))
    problem = F.when(~exact, "payload").when(~(texts & numbers), "type").when(~text("content_sha256").rlike(r"\A[0-9a-f]{64}\z"), "digest").when(~F.coalesce(F.lower("id") == own, F.lit(False)), "id")
    rows = rows.withColumn("problem", problem)
    field = lambda value, name: F.when(F.col("problem").isNull(), value).alias(name)
    return rows.select(*keep, "id", *[field(text(n), n) for n in ("document_id", "chunk_id", "text", "content_sha256")], field(whole("ordinal").cast("int"), "ordinal"), field(whole("page_number").cast("int"), "page_number"), "problem")


def require_decoded(points: DataFrame, namespace: uuid.UUID) -> DataFrame:
    """The decoded points; one that can't be trusted means that the store can't be used."""
    found = decode_payloads(points, namespace)
    if found.filter("problem is not null").limit(1).count():
        raise DependencyUnavailableError("a stored entry can't be read")
    return found.drop("problem")
