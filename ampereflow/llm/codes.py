"""Vector codes: product quantisation whose codebooks are learned by delta-maintained Lloyd rounds.

Vectors become integers and are cut into equal parts, each coded by the nearest entry of its position's
codebook. The vectors are written once, bucketed by row; so are each round's assignments, and a round
joins the two bucket by bucket, without a shuffle. A task sums, in integers, what its parts take from the
entry that they leave and bring to the entry that they join. Only these plus and minus contributions of
parts that moved, at most one row for each entry in a batch, are shuffled and added to the running
sums; the codebooks of the next round are quotients of these. Integers make every order of addition give
the same sums, so a lost executor's tasks can run again.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, drop_table, materialize, shared_dir

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components beyond this magnitude are set to it, so that distances stay in 64 bits.
BOUND = 1 << 26
#: Up to this magnitude products are exact in double precision.
_EXACT = 1 << 20
#: Rows of one bucket of the written tables.
BUCKET_ROWS = 200_000
DELTAS = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """The rows of a column of equally long byte strings."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1)


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers, the lowest index of its nearest entry and the squared distance, exactly."""
    if max(np.abs(part).max(initial=0), np.abs(codebook).max(initial=0)) <= _EXACT and part.shape[1] < 512:
        x, c = part.astype(np.float64), codebook.astype(np.float64)
        squares = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    else:
        squares = np.stack([((part.astype(np.int64) - entry) ** 2).sum(1) for entry in codebook], axis=1)
    best = squares.argmin(1)
    return best.astype(np.uint8), squares[np.arange(len(part)), best].astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(row, id, label, size, ints)`` of the rows that are kept: finite vectors as little-endian 32-bit integers.

    Rows whose vector is null, empty, or holds null or non-finite components go, and those whose length
    can't be cut into ``PARTS`` equal parts.
    """
    label_kind = dict(vectors.dtypes)[label_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ints = np.clip(values, -BOUND, BOUND).astype("<i4").tobytes()
            stops = (4 * np.cumsum(sizes)).tolist()
            raw = list(map(ints.__getitem__, map(slice, [0, *stops], stops)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], names=["row", "id", "label", "size", "ints"])

    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & finite)
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"row bigint, id {dict(vectors.dtypes)[id_col]}, label {label_kind}, size int, ints binary")


def _bucketed(df: DataFrame, name: str, buckets: int, folder: str) -> DataFrame:
    """``df`` written under the shared folder, bucketed by ``row``, and read back."""
    spark = df.sparkSession
    df.write.bucketBy(buckets, "row").format("parquet").option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name)


def _assign(rows: DataFrame, codebooks: np.ndarray, previous: bool) -> DataFrame:
    """``(row, codes, deltas)``: each row's entries, and once a batch what the batch adds to the sums of entries.

    ``rows`` has ``row``, ``ints`` and, with ``previous``, ``codes``, the assignment before.
    """
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(1), "<i4").reshape(-1, parts, width)
            before = _matrix(batch.column(2), np.uint8) if previous else None
            codes = np.stack([nearest(values[:, p], codebooks[p])[0] for p in range(parts)], axis=1)
            deltas = []
            for p in range(parts):
                moved = slice(None) if before is None else codes[:, p] != before[:, p]
                x, sums, counts = values[moved, p].astype(np.int64), np.zeros((entries, width), np.int64), np.zeros(entries, np.int64)
                for sign, side in ((1, codes), (-1, before)):
                    if side is not None:
                        np.add.at(sums, side[moved, p], sign * x)
                        counts += sign * np.bincount(side[moved, p], minlength=entries)
                used = np.flatnonzero(counts | sums.any(1))
                deltas += [{"part": p, "entry": int(e), "n": int(counts[e]), "sums": sums[e].tolist()} for e in used]
            raw = codes.tobytes()
            column = pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary())
            kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array([deltas or None] + [None] * (len(codes) - 1), kind)], names=["row", "codes", "deltas"])

    return rows.mapInArrow(run, f"row bigint, codes binary, deltas {DELTAS}")


def _add(state: DataFrame, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the contributions of ``state`` to the running counts and sums: one row for each entry reaches the driver."""
    width = sums.shape[2]
    each = state.filter("deltas is not null").select(F.explode("deltas").alias("d")).select("d.part", "d.entry", "d.n", "d.sums")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    for r in total.collect():
        counts[r.part, r.entry] += r.n
        sums[r.part, r.entry] += np.array([r[f"s{i}"] for i in range(width)], np.int64)


def train(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS, label: str = "codes") -> np.ndarray:
    """Codebooks ``(parts, entries, width)`` after ``rounds`` of Lloyd's method on ``rows (row, ints)``, from ``first``."""
    spark: SparkSession = rows.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS))
    name = f"{label}_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"
    base = _bucketed(rows.select("row", "ints").repartition(buckets, "row"), f"{name}_base", buckets, folder)
    tables, state = [f"{name}_base"], None
    codebooks = first.astype(np.int64)
    counts, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
    for n in range(rounds):
        seen = base if state is None else base.join(state.select("row", "codes"), "row").select("row", "ints", "codes")
        state = _bucketed(_assign(seen, codebooks, state is not None), f"{name}_{n}", buckets, folder)
        tables.append(f"{name}_{n}")
        _add(state, counts, sums)
        codebooks = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)
        if n:
            _forget(spark, tables.pop(-2))
    for table in tables:
        _forget(spark, table)
    return codebooks


def _forget(spark: SparkSession, table: str) -> None:
    """Drop a written table and its files."""
    drop_table(spark.table(table))
    spark.sql(f"DROP TABLE {table}")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(id, label, codes, error)`` of each kept row, and the codebooks.

    ``codes`` holds one byte for each part, ``error`` the squared distance of the integer vector to its
    entries. The codebooks begin with the parts of the ``ENTRIES`` smallest ids (null ids last; rows of one
    id by their integers). Vectors that are null, empty or hold null or non-finite components are left out,
    also those whose length isn't a multiple of ``PARTS`` or isn't that of the smallest id's vector. Fewer
    rows than entries give smaller codebooks; repeated rows count as often as they occur; no rows give an
    empty table and empty codebooks. Components beyond 16,384 in magnitude count as that much.
    """
    rows = materialize(integers(vectors, id_col, vector_col, label_col), "ints")
    order = [F.col("id").asc_nulls_last(), "ints"]
    start = rows.orderBy(*order).limit(1).first()
    size = start["size"] if start else PARTS
    rows = rows.filter(F.col("size") == size)
    picked = [np.frombuffer(r.ints, "<i4") for r in rows.orderBy(*order).limit(ENTRIES).collect()]
    width = size // PARTS
    codebooks = np.array(picked, np.int64).reshape(len(picked), PARTS, width).transpose(1, 0, 2)
    if len(picked):
        codebooks = train(rows, codebooks)
    columns = ["id", "label", "codes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(2), "<i4").reshape(-1, PARTS, width)
            found = [nearest(values[:, p], codebooks[p]) for p in range(PARTS)]
            raw = np.stack([codes for codes, _ in found], axis=1).tobytes()
            codes = pa.array([raw[i : i + PARTS] for i in range(0, len(raw), PARTS)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(sum(d for _, d in found))], names=columns)

    kinds = dict(rows.dtypes)
    coded = rows.select("id", "label", "ints").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes binary, error bigint")
    coded = materialize(coded, "coded")
    drop_table(rows)
    return coded, codebooks


def decompress(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``coded`` with ``vector``, the entries of its codes as an array of doubles."""
    entries = [[F.array(*[F.lit(float(v) / SCALE) for v in entry]) for entry in book] for book in codebooks]

    def entry(p: int):
        code = F.conv(F.hex(F.substring("codes", p + 1, 1)), 16, 10).cast("int")
        return F.array(*entries[p])[code]

    return coded.withColumn("vector", F.concat(*[entry(p) for p in range(len(codebooks))]))


def with_label_error(coded: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label summed (null labels together, null beyond 64 bits)."""
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.join(broadcast_within(sums, broadcast_rows), F.col("label").eqNullSafe(F.col("of"))).drop("of")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' integers, joined by commas in order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir):
    """Code and error of every vector, the errors of its label and a digest of the codebooks."""
    coded, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(coded)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: each round's assignment and means follow from the round before."""
    finite = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {PARTS} AS w FROM embeddings WHERE {finite})",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM kept, range({PARTS}) AS t(p))",
        f"starts AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS e FROM kept QUALIFY e < {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN starts USING (vec_id))",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(n: int) -> str:
        pick = f"SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, label, parts.p, x, e, {distance} AS d FROM parts JOIN book{n} ON parts.p = book{n}.p) GROUP BY ALL"
        return f"near{n} AS MATERIALIZED ({pick})"

    for n in range(ROUNDS):
        steps.append(assigned(n))
        means = f"SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM near{n}, (SELECT unnest(range(1, (SELECT max(w) FROM kept) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e"
        steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} AS b LEFT JOIN ({means}) AS m ON b.p = m.p AND b.e = m.e)")
    steps.append(assigned(ROUNDS))
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha"


OP13_SQL = _sql()
