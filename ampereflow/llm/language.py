"""Language of web pages by Bayesian fusion of four kinds of evidence.

The text's character n-grams, the language that the markup declares, the suffix of the address, and
what is known of the host: log-probabilities of each are added and normalised. What hosts publish is
smoothed from the global shares over the domain down to the host, and all tables but the n-grams' are
counted over all pages by grouped aggregation.
"""

from __future__ import annotations

import html
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize, text_or_empty

#: Bytes in an n-gram, and bits of its hash.
SIZE, BITS = 3, 14
#: Most labelled rows that the n-gram model learns from (those of least hash of their id).
MAX_TRAIN = 8000
#: An n-gram model overstates long texts; beyond so many n-grams a text weighs no more.
EFFECTIVE = 60
#: Weight of the level above in each smoothing step, and the count added to every cell.
PRIOR_WEIGHT, ADDED = 5.0, 0.5
#: Most hosts, domains, suffixes or declared languages whose counts are broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 50_000
_OPEN = re.compile(r"<(?:(script|style)\b|!--)?", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!": re.compile("-->"), "": re.compile(">")}
_CLEAN = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))
_PIECE = 1 << 20


def visible_text(page: str) -> str:
    """A page without scripts, styles, comments and tags, its entities resolved.

    An opening is closed by the next closing of its kind; a script, style or comment that is never closed
    is a tag like others, and a ``<`` without any ``>`` behind it is text. One pass over the page: a kind
    that is not closed behind one place is not closed behind any later one and is not looked for again.
    """
    out, at = [], 0
    open_kinds: set[str] = set()
    found = _OPEN.search(page)
    while found:
        kind = (found.group(1) or ("!" if found.group(0) == "<!--" else "")).lower()
        end = None
        for name in (kind, "") if kind else ("",):
            if name not in open_kinds:
                # a script or style closes behind its opening, a comment behind its dashes, a tag anywhere behind its start
                end = _CLOSE[name].search(page, found.end() if name else found.start() + 1)
                if end:
                    break
                open_kinds.add(name)
        if end:
            out += [page[at : found.start()], " "]
            at = end.end()
        elif "" in open_kinds:
            break
        found = _OPEN.search(page, max(at, found.start() + 1))
    return html.unescape("".join([*out, page[at:]]))


def grams(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased whole text occurs; runs of other than letters are one space."""
    data = np.frombuffer((b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()) + b" "), np.uint8)
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, max(len(data) - SIZE + 1, 0), _PIECE):
        part = data[at : at + _PIECE + SIZE - 1].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        total += np.bincount((code * np.uint32(2654435769)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each n-gram in each, smoothed by adding one.

    Counted by Spark over at most ``max_train`` rows; rows without label or id are left out. The number
    of languages is that of different labels.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("lang"), text_or_empty(text_col).alias("text")).filter("id is not null and lang is not null")
    picked = known.select("id").orderBy(F.xxhash64("id"), "id").limit(max_train).distinct()
    sample = known.join(F.broadcast(picked), "id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + grams(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "gram", "n"])

    rows = sample.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # languages times 2^BITS at most
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.ones((len(langs), 1 << BITS))
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(counts, ([place[x] for x in rows.column("lang").to_pylist()], rows.column("gram").to_numpy()), rows.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, domain, suffix, declared, text_ll array<double>, text_lang`` for each page.

    ``declared`` is the primary subtag of the ``html`` element's ``lang``, ``suffix`` the last label of
    the host and ``domain`` its last two; each is an empty text where there is none.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(2).to_pylist():
                counts = grams(visible_text(page))
                at = np.flatnonzero(counts)
                n = counts[at].sum()
                out.append((model[:, at] @ counts[at] * (EFFECTIVE / max(n, EFFECTIVE))).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1)), batch.column(3), pa.array(out, pa.list_(pa.float64()))], names=["id", "host", "declared", "text_ll"])

    page = text_or_empty(html_col)
    host = F.lower(F.regexp_extract(text_or_empty(url_col), r"^[^:/?#]*://([^/?#:]*)", 1))
    attributes = F.regexp_extract(page, r"(?i)<html\b([^>]*)", 1)  # of the first html element
    declared = F.lower(F.regexp_extract(attributes, r"""(?i)\slang\s*=\s*["']?([A-Za-z]+)""", 1))
    kind = dict(pages.dtypes)[id_col]
    marked = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), page.alias("page"), declared.alias("declared"))
    marked = marked.mapInArrow(weigh, f"id {kind}, host string, declared string, text_ll array<double>")
    names = F.array(*map(F.lit, langs))
    best = F.get(names, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1)
    return marked.select("id", "host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "declared", "text_ll", best.alias("text_lang"))


def _tally(rows: DataFrame, key: str, langs: list[str], name: str) -> DataFrame:
    """For each key, an array of how many pages have each text language; pre-aggregated by Spark."""
    one = F.array(*[F.count(F.when(F.col("text_lang") == lang, 1)).cast("double") for lang in langs])
    return rows.groupBy(F.col(key).alias(f"__{name}")).agg(one.alias(name))


def _less_own(counts: Column, own: Column) -> Column:
    return F.zip_with(counts, own, lambda n, o: n - o)


def _smoothed(counts: Column, above: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    return F.zip_with(counts, above, lambda n, p: (n + PRIOR_WEIGHT * p) / (total + PRIOR_WEIGHT))


def identify(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Language of each page: the id, ``lang, probability, text_lang, declared``.

    A page's own text is taken out of the counts of its host, domain and suffix, so it is no evidence
    twice. Ties go to the first language by name. Pages without text, markup or address are judged by
    what evidence there is, in the end by the global shares. Rows that repeat get a row each; other
    columns are not read. Without languages ``lang`` is null. A host that holds a third of all pages is
    one pre-aggregated row of a written table, which its pages meet by a bounded broadcast or in a join
    that Spark can split.
    """
    if not langs:
        return pages.select(F.col(f"`{id_col}`").alias(id_col), *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))])
    rows = materialize(evidence(pages, langs, model, id_col, url_col, html_col), "evidence")
    names = F.array(*map(F.lit, langs))
    own = F.transform(names, lambda x: F.when(x == F.col("text_lang"), 1.0).otherwise(0.0))
    joined = rows.withColumn("own", own)
    for key in ("host", "domain", "suffix", "declared"):
        tally = materialize(_tally(rows, key, langs, f"by_{key}"), "tally")
        joined = joined.join(broadcast_within(tally, BROADCAST_ROWS), F.col(key) == F.col(f"__by_{key}"), "left").drop(f"__by_{key}")
    everything = rows.agg(F.array(*[F.count(F.when(F.col("text_lang") == lang, 1)).cast("double") for lang in langs]).alias("a")).first().a
    whole = F.array(*[F.lit(float(n)) for n in everything])
    size = F.lit(float(sum(everything)))
    shares = F.transform(_less_own(whole, F.col("own")), lambda n: (n + ADDED) / (size + len(langs) * ADDED))
    joined = joined.withColumn("global", shares)
    joined = joined.withColumn("prior_domain", _smoothed(_less_own(F.col("by_domain"), F.col("own")), F.col("global")))
    joined = joined.withColumn("prior", _smoothed(_less_own(F.col("by_host"), F.col("own")), F.col("prior_domain")))

    def likelihood(counts: str) -> Column:
        """P(value | language) relative to its chance: smoothed share of the value's pages over the global share."""
        return F.zip_with(_smoothed(_less_own(F.col(counts), F.col("own")), F.col("global")), F.col("global"), lambda p, g: F.log(p) - F.log(g))

    joined = joined.withColumn("from_suffix", likelihood("by_suffix")).withColumn("from_markup", F.when(F.col("declared") == "", F.transform("own", lambda _: F.lit(0.0))).otherwise(likelihood("by_declared")))
    terms = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.log(F.get("prior", i)) + F.get("text_ll", i) + F.get("from_suffix", i) + F.get("from_markup", i))
    joined = joined.withColumn("log_posterior", terms).withColumn("top", F.array_max("log_posterior"))
    norm = F.aggregate("log_posterior", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    lang = F.get(names, F.array_position("log_posterior", F.col("top")).cast("int") - 1)
    return joined.select(F.col("id").alias(id_col), lang.alias("lang"), (1.0 / norm).alias("probability"), "text_lang", F.nullif("declared", F.lit("")).alias("declared"))


def op2_language(spark, sf_dir):
    """Language of every page, by n-grams learned from the documents' declared languages."""
    langs, model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), langs, model)
