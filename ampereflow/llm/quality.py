"""Text quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, materialize, text_or_empty

#: Terms: runs of three character kinds, hashed words, a word that follows itself, and a word met before.
KINDS = 32
SHAPES = KINDS**3
WORD_BITS = 14
TERMS = SHAPES + (1 << WORD_BITS) + 2
#: Most labelled rows that are kept as neighbours (those of least hash of their id), and most characters of theirs.
MAX_LABELLED, MAX_LABELLED_CHARS = 4000, 32 << 20
DIMENSIONS = 64
NEIGHBOURS = 15
#: Terms found in fewer labelled texts are left out: a term of one text makes no two texts alike.
MIN_TEXTS = 2
#: Exponent of the cosine in a neighbour's weight.
SHARPNESS = 4
THRESHOLD = 0.3
_BLOCK = 256
_PIECE = 1 << 20
#: Characters that are a kind of their own; other kinds are capital, small letter, digit, white space, other.
_OWN = "!#$%&*|.,;:?'\"()-_=+/<>@\\{}"
_KIND = np.full(256, 4, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_KIND[range(ord("A"), ord("Z") + 1)] = 0
_KIND[range(ord("0"), ord("9") + 1)] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
for _i, _c in enumerate(_OWN):
    _KIND[ord(_c)] = 5 + _i % (KINDS - 5)
_KINDS = _KIND.tobytes()


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the whole text and how often each occurs; words are lower-cased in ASCII."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.translate(_KINDS), np.uint8)
    shapes = np.zeros(SHAPES, np.int64)
    for at in range(0, max(len(data) - 2, 0), _PIECE):
        part = data[at : at + _PIECE + 2].astype(np.int32)
        shapes += np.bincount((part[:-2] * KINDS + part[1:-1]) * KINDS + part[2:], minlength=SHAPES)
    found = np.flatnonzero(shapes)
    words = raw.lower().split()
    different = Counter(words)
    hashed = np.fromiter(map(crc32, different), np.uint32, len(different)) >> np.uint32(32 - WORD_BITS)
    hashed, place = np.unique(hashed, return_inverse=True)
    times = np.bincount(place, np.fromiter(different.values(), np.int64, len(different)), len(hashed)).astype(np.int64)
    repeats = [(TERMS - 2, sum(map(eq, words, words[1:]))), (TERMS - 1, len(words) - len(different))]
    terms = np.concatenate([found, SHAPES + hashed.astype(np.int64), [t for t, n in repeats if n]])
    return terms.astype(np.int64), np.concatenate([shapes[found], times, [n for _, n in repeats if n]]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``place`` maps terms to kept columns (-1: left out); ``basis`` has the latent dimensions scaled by idf."""

    place: np.ndarray
    basis: np.ndarray
    neighbours: np.ndarray
    labels: np.ndarray
    prior: float

    def vectors(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.zeros((len(counted), self.basis.shape[1]), np.float32)
        for row, (terms, counts) in zip(z, counted):
            at = self.place[terms]
            if len(counts):
                row[:] = np.sqrt(counts[at >= 0] / counts.sum()).astype(np.float32) @ self.basis[at[at >= 0]]
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, by exact cosines in blocks."""
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts) if k else 0, _BLOCK):
            cosines = self.vectors([term_counts(t) for t in texts[i : i + _BLOCK]]) @ self.neighbours.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[i : i + _BLOCK] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


@dataclass(frozen=True)
class Sparse:
    """Rows of a sparse matrix: the columns and values of each, one after the other, and where each row begins."""

    columns: np.ndarray
    values: np.ndarray
    begins: np.ndarray
    width: int

    def _blocks(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        for i in range(0, len(self.begins) - 1, _BLOCK):
            j = min(i + _BLOCK, len(self.begins) - 1)
            yield i, j, slice(self.begins[i], self.begins[j]), np.repeat(np.arange(j - i), np.diff(self.begins[i : j + 1]))

    def times(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.begins) - 1, q.shape[1]), np.float32)
        for i, j, part, row in self._blocks():
            dense = np.zeros((j - i, self.width), np.float32)
            dense[row, self.columns[part]] = self.values[part]
            out[i:j] = dense @ q
        return out

    def back(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, z.shape[1]), np.float32)
        for i, j, part, row in self._blocks():
            dense = np.zeros((j - i, self.width), np.float32)
            dense[row, self.columns[part]] = self.values[part]
            out += dense.T @ z[i:j]
        return out


def latent_basis(x: Sparse, dimensions: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of ``x`` by subspace iteration; a block of rows at a time is dense."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.width, min(dimensions + 8, x.width, len(x.begins) - 1))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.back(x.times(q)))
    _, _, turned = np.linalg.svd(x.times(q), full_matrices=False)
    return (q @ turned.T)[:, :dimensions]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_chars: int = MAX_LABELLED_CHARS) -> Model:
    """Latent vectors of at most ``max_labelled`` labelled rows and ``max_chars`` characters of ``docs`` (see ``labelled_sample``).

    Spark counts the terms of the picked texts; inverse document frequencies are the terms' only weights,
    and a truncated singular value decomposition of the bounded sparse table gives the latent dimensions.
    A picked text sends the driver at most as many terms as it has characters. Null texts are empty, and
    repeated rows are neighbours as often as they occur. Without any labelled text every score is one
    half. Only the id, text and label columns are read, so other columns can't clash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [term_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in counted], pa.list_(pa.int32())), pa.array([c for _, c in counted], pa.list_(pa.int32()))], names=["label", "terms", "counts"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled, max_chars)
    table = materialize(sample.mapInArrow(count, "label int, terms array<int>, counts array<int>"), "terms").toArrow()  # at most max_labelled rows of max_chars terms
    y = table.column("label").to_numpy().astype(np.float64)
    terms = [np.asarray(t.values, np.int32) for t in table.column("terms")]
    counts = [np.asarray(c.values, np.int64) for c in table.column("counts")]
    prior = float((y.sum() + 1) / (len(y) + 2))
    texts_with = np.bincount(np.concatenate([*terms, np.empty(0, np.int32)]), minlength=TERMS)
    kept = np.flatnonzero(texts_with >= MIN_TEXTS)
    place = np.full(TERMS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    if not len(kept):
        return Model(place, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    idf = (np.log((1 + len(y)) / (1 + texts_with[kept])) + 1).astype(np.float32)
    columns, values = [], []
    for t, c in zip(terms, counts):
        at = place[t]
        row = (np.sqrt(c / max(c.sum(), 1))[at >= 0] * idf[at[at >= 0]]).astype(np.float32)
        columns.append(at[at >= 0])
        values.append(row / max(float(np.linalg.norm(row)), 1e-12))
    x = Sparse(np.concatenate(columns), np.concatenate(values), np.cumsum([0, *map(len, columns)]), len(kept))
    basis = (idf[:, None] * latent_basis(x, DIMENSIONS)).astype(np.float32)
    model = Model(place, basis, np.zeros((0, 1), np.float32), y, prior)
    return Model(place, basis, model.vectors(list(zip(terms, counts))).astype(np.float32), y, prior)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row, 0 to 1, higher where label 1 is likelier.

    The labelled vectors are bounded by ``max_labelled`` and sent to the executors with the model. Null
    and empty texts have no terms and get the smoothed share of label 1. Repeated rows and rows without
    id are scored like any other; an empty table gives no rows.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return docs.select(F.col(f"`{id_col}`").alias(id_col), score(text_or_empty(text_col)).alias("score"))


def held_out(id_col: Column) -> Column:
    """Rows whose labels this package's registered query never learns from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_quality(spark, sf_dir):
    """A score for every document, by neighbours whose labels are never held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"))))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
