"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, text_or_empty

#: Lengths in bytes of the n-grams; a feature is a hashed n-gram that occurs, or one that occurs more than once.
SIZES = (4, 6, 8)
BITS = 19
FEATURES = 2 << BITS
#: Most labelled rows that a fit uses (those of least hash of their id), and most characters of theirs.
MAX_TRAIN, MAX_TRAIN_CHARS = 8000, 64 << 20
SMOOTHING = 0.5
#: Standard errors by which a feature's shares in the two classes must differ to be one.
LEAST_Z = 3.0
PENALTY, STEPS = 0.1, 250
THRESHOLD = 0.7
_PIECE = 1 << 20
_CLEAN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, piece by piece so that long texts take bounded memory.

    Runs of ASCII punctuation and white space become one space, and a space stands at both ends. Pieces
    overlap, so that every n-gram of the whole text is seen once.
    """
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()) + b" ", np.uint8)
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE + max(SIZES) - 1].astype(np.uint32)
        rolling = part.copy()
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            rolling = rolling[:-1] * np.uint32(16777619) + part[n - 1 :]
            if n in SIZES:
                own = rolling[:_PIECE]
                yield ((own ^ (own >> np.uint32(15))) * np.uint32(2654435769 + 2 * n)) >> np.uint32(32 - BITS)


def features(text: str, known: np.ndarray | None = None) -> np.ndarray:
    """The text's features, each once: an n-gram's hash, and that plus ``1 << BITS`` if it is repeated.

    With ``known`` only n-grams whose hash it marks are looked at.
    """
    ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def tally() -> None:
        nonlocal ids, counts
        own, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        if len(ids):
            own, place = np.unique(np.concatenate([ids, own]), return_inverse=True)
            times = np.bincount(place, np.concatenate([counts, times])).astype(np.int64)
        ids, counts = own, times

    for hashed in grams(text):
        held.append(hashed if known is None else hashed[known[hashed]])
        if sum(map(len, held)) > 4 * _PIECE:
            tally()
    if held:
        tally()
    return np.concatenate([ids, ids[counts > 1].astype(np.int64) + (1 << BITS)]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Kept features, in order, and the number that each adds to the margin."""

    ids: np.ndarray
    values: np.ndarray
    bias: float

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros(FEATURES, np.float32)
        out[self.ids] = self.values
        return out

    @cached_property
    def known(self) -> np.ndarray:
        return (self.weights.reshape(2, -1) != 0).any(0)

    def score(self, text: str) -> float:
        margin = float(self.weights[features(text, self.known)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each class a feature is present."""
    seen = np.zeros((2, FEATURES), np.int32)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[label, features(text)] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(seen[k, at].astype(np.int64)) for k in (0, 1))], names=["f", "neg", "pos"])


def logistic(at: np.ndarray, sizes: np.ndarray, ratios: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on a sparse design by accelerated gradient descent; the bias has no penalty.

    Row i holds the next ``sizes[i]`` columns of ``at``, each with its ratio as the value. Both classes
    weigh the same in all, so that few occurrences in a text are enough. The step is set by the largest
    curvature, found by power iteration.
    """
    n, k = len(y), len(ratios)
    rows, values = np.repeat(np.arange(n), sizes), ratios[at]
    weight = np.where(y > 0, (n - y.sum()) / y.sum(), 1.0)
    times = lambda v: np.bincount(rows, values * v[at], n)
    back = lambda u: np.bincount(at, values * u[rows], k)
    v = np.ones(k)
    for _ in range(15):
        v /= np.linalg.norm(v) + 1e-12
        v = back(weight * times(v))
    rate = 1.0 / (0.25 * float(np.linalg.norm(v)) / n + 0.3 * float(weight.mean()) + penalty / n)
    w, b = np.zeros(k), 0.0
    v, c = w.copy(), b
    for step in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(times(v) + c, -40, 40))) - y)
        w2, b2 = v - rate * (back(error) / n + penalty / n * v), c - rate * float(error.mean())
        momentum = step / (step + 3)
        v, c = w2 + momentum * (w2 - w), b2 + momentum * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS, least_z: float = LEAST_Z) -> Model:
    """Fit on at most ``max_train`` labelled rows and ``max_chars`` characters of ``docs`` (see ``labelled_sample``).

    Spark counts the texts of each class that have each feature; r is the log ratio of the smoothed
    counts. Every feature whose shares in the classes differ by ``least_z`` standard errors or more is
    kept, however many there are; each text becomes the vector of r for the features it has, and a
    logistic regression is fitted on these. The driver gets one number for each kept feature of a
    sampled text. Null texts are empty; repeated rows of an id count as often as they occur. Without
    rows of both classes the model gives every text the smoothed share of label 1. Only the id, text
    and label columns are read, so other columns can't clash.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_train, max_chars)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = sizes.get(0, 0), sizes.get(1, 0)
    nothing = np.empty(0, np.int64), np.empty(0, np.float32)
    if not neg or not pos:
        share = (pos + SMOOTHING) / (neg + pos + 2 * SMOOTHING)
        return Model(*nothing, float(np.log(share / (1 - share))))
    counted = sample.mapInArrow(_counts, "f int, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + SMOOTHING) / (pos + 2 * SMOOTHING)) - F.log((F.col("neg") + SMOOTHING) / (neg + 2 * SMOOTHING))
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    error = F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    telling = F.abs(F.col("pos") / pos - F.col("neg") / neg) >= least_z * error
    kept = counted.filter(telling & (share < 1)).select("f", ratio.cast("float").alias("r")).toArrow()  # at most FEATURES rows of two numbers
    order = np.argsort(kept.column("f").to_numpy())
    ids, ratios = kept.column("f").to_numpy()[order].astype(np.int64), kept.column("r").to_numpy()[order]
    known = np.zeros(1 << BITS, bool)
    known[ids & ((1 << BITS) - 1)] = True

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(FEATURES, -1, np.int32)
        place[ids] = np.arange(len(ids))
        for batch in batches:
            rows = [p[p >= 0] for p in (place[features(t, known)] for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["label", "at"])

    design = sample.mapInArrow(restrict, "label int, at array<int>").toArrow().combine_chunks()
    at = design.column("at").combine_chunks()
    w, bias = logistic(at.flatten().to_numpy(), at.value_lengths().to_numpy(), ratios.astype(np.float64), design.column("label").to_numpy().astype(np.float64))
    return Model(ids, (w * ratios).astype(np.float32), bias)


def scorer(model: Model):
    """An Arrow function from texts to scores between 0 and 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row; null texts score like empty ones, by the bias alone.

    Texts of any length are read whole, in pieces. Repeated rows and rows without id get a row each, an
    empty table gives none; other columns are not read, so they can't clash.
    """
    return docs.select(F.col(f"`{id_col}`").alias(id_col), scorer(model)(text_or_empty(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``; all columns stay, whatever their names.

    Null and empty texts score by the bias alone; repeated rows share their fate, rows without id are
    judged like others, and an empty table stays empty.
    """
    return docs.filter(scorer(model)(text_or_empty(text_col)) < threshold)


def held_out(id_col: Column) -> Column:
    """Rows whose labels this package's registered query never learns from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_registered(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def op4_toxicity(spark, sf_dir):
    """A score for every document, by a model that never saw the labels of held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_registered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
