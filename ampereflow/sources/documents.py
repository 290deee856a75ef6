"""Documents to text chunks, their embeddings, and indexing."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DependencyUnavailableError, InvalidRequestError
from ..functions.normalize import clean_text
from ..operators import vectors
from ..schemas import stripped
from ..shared import materialize

CHUNK_SCHEMA = "document_id string, chunk_id string, ordinal int, text string, page_number int"


def split_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chunk for each line with text: ordinals count chunks, page numbers count lines from 1."""
    pieces = F.transform(F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n?", "\n"), "\n"), lambda t, i: F.struct(stripped(t).alias("text"), (i + 1).alias("page")))
    kept = docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.filter(pieces, lambda p: p["text"] != "")).alias("ordinal", "p"))
    return kept.select("document_id", F.concat_ws(":", "document_id", F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", F.col("p.text").alias("text"), F.col("p.page").alias("page_number"))


def extract_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of page texts of the files at ``path``, and ``(path, code)`` diagnostics.

    Any failure of a file drops all its chunks (``document_unreadable``); a file without text is
    ``document_without_text``. The default reader needs the optional PDF library.
    """

    def pages(content: bytes) -> list[str]:
        if reader is not None:
            return reader(content)
        import io

        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for name, content in zip(table["path"], table["content"]):
                try:
                    rows = [(name, i, t, None) for i, t in enumerate(pages(bytes(content)), 1)] or [(name, 0, "", None)]
                except Exception:  # whatever a malformed file provokes
                    rows = [(name, 0, "", "document_unreadable")]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "code"])

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_number int, text string, code string")
    cleaned = read.withColumn("text", clean_text(F.col("text")))
    whole = cleaned.groupBy("path").agg(F.first("code", True).alias("code"), F.max(F.col("text") != "").alias("some"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text")))).alias("pages"))
    notes = whole.select("path", F.coalesce("code", F.when(~F.col("some"), "document_without_text")).alias("code")).filter("code is not null")
    chunks = whole.filter("code is null").select(F.col("path").alias("document_id"), F.posexplode("pages").alias("ordinal", "p"))
    return chunks.select("document_id", F.concat_ws(":", "document_id", F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", F.col("p.text").alias("text"), F.col("p.page_number").alias("page_number")), notes


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """A vector for each chunk, in Arrow batches; the model must answer one vector of one size a text."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            if not len(table):
                continue
            found = model(table["text"].tolist())
            if len(found) != len(table) or len({len(v) for v in found}) != 1:
                raise DependencyUnavailableError("the model answered with other vectors than asked for")
            yield table[["document_id", "chunk_id"]].assign(vector=[[float(x) for x in v] for v in found])

    return chunks.select("document_id", "chunk_id", "text").mapInPandas(run, "document_id string, chunk_id string, vector array<double>")


def embed_query(text: str, model: Callable[[list[str]], list[list[float]]]) -> list[float]:
    if not text.strip():
        raise InvalidRequestError("the query is blank")
    found = model([text])
    if len(found) != 1 or not found[0]:
        raise DependencyUnavailableError("the model answered with other vectors than asked for")
    return [float(x) for x in found[0]]


def index_chunks(chunks: DataFrame, model, path: str, dimension: int) -> int:
    """Embed and index chunks; nothing is asked of the model without chunks."""
    if not chunks.limit(1).count():
        return 0
    embedded = materialize(embed(chunks, model), "embedded")  # the model is asked once
    vectors.require_complete(chunks, embedded, dimension)
    return vectors.index(vectors.prepare(chunks, embedded), path, dimension, "ordinal", "text")


def infer_constraints(spark: SparkSession, text: str, limit: int, model, path: str, infer: Callable[[list], list[dict]], distance: str = "cosine") -> list[dict]:
    """Query, search, infer: constraints whose evidence is among the chunks found; none without chunks."""
    stored = spark.read.parquet(path)
    found = vectors.search(stored, embed_query(text, model), limit, distance).orderBy("rank").collect()  # at most limit rows
    if not found:
        return []
    known = {r.chunk_id for r in found}
    texts = {r.chunk_id: r.text for r in stored.filter(F.col("chunk_id").isin(*known)).select("chunk_id", "text").collect()}
    answers = infer([(r.document_id, r.chunk_id, texts[r.chunk_id]) for r in found])
    if any(not set(a.get("evidence_chunk_ids", ())) <= known or not a.get("evidence_chunk_ids") for a in answers):
        raise DependencyUnavailableError("an answer cites unknown evidence")
    return answers
