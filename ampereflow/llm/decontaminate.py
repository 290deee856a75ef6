"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is found in a document that holds at least ``THRESHOLD`` of the item's distinct five-word
shingles. Items are short and documents long, so one sketch of a whole document would almost never
agree with an item's. Containment needs less: if an item of q shingles is contained, at most
q - ceil(t q) of them are missing, so among any q - ceil(t q) + 1 of its shingles one is in the
document. Each item is therefore sketched by that many of its smallest hashes (a bottom-k MinHash whose
k follows from the upper size of the item's size partition), and a document is a candidate when it has a
shingle with such a hash. Documents drop every shingle whose hash is above the largest sketch value of
the partitions their size can reach before anything is joined, and no contained item is ever missed.
Candidates are verified by counting equal shingle texts.

An item of fewer than five words is one shingle of its own length, and is contained where these words follow one
another. Such items are classes of their own by length: a document's runs of that many words meet them by their text, which is
the exact check as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize, text_or_empty, without_ids

WORDS = 5
THRESHOLD = 0.8
#: Most sketch rows, item shingles and document ids that are broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 500_000
#: Most short items of one length that a document's runs are looked up in before they become rows; more are joined at once.
IN_ROW = 1000


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _positions() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("__w") - WORDS, F.lit(0)))


def shingle_texts() -> Column:
    """Distinct shingles of ``__w`` as texts; fewer than five words make one shingle, none make none.

    Words are taken one by one, as a slice would copy all words of the text for each shingle.
    """
    return F.when(F.size("__w") > 0, F.array_distinct(F.transform(_positions(), lambda i: F.concat_ws(" ", *[F.get("__w", i + j) for j in range(WORDS)])))).otherwise(F.array().cast("array<string>"))


def shingle_hashes() -> Column:
    """Hashes of the shingles of ``__w`` in order, repeats included; equal shingles have equal hashes."""
    each = F.transform(_positions(), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(WORDS)]))
    return F.when(F.size("__w") > 0, each).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, q, __w`` with q the number of distinct shingles; items without words or id are left out."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), words(text_or_empty(text_col)).alias("__w")).filter("item is not null and size(__w) > 0")
    return rows.withColumn("q", F.size(F.array_distinct(shingle_hashes())))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``h, item, need, part``: each item's smallest hashes; ``part`` is its size partition [2^p, 2^(p+1))."""
    part = F.floor(F.log2("q")).cast("int")
    upper = F.least(F.pow(F.lit(2), part + 1) - 1, F.col("q").cast("double"))
    need = F.ceil(F.col("q") * threshold - 1e-9).cast("int")
    k = (upper - F.ceil(upper * threshold - 1e-9) + 1).cast("int")
    lowest = F.slice(F.array_sort(F.array_distinct(shingle_hashes())), 1, k)
    return items.select(F.explode(lowest).alias("h"), "item", need.alias("need"), part.alias("part"))


def _runs(length: int, known: list[str] | None) -> Column:
    """The distinct runs of ``length`` words of ``__w``; with ``known``, those alone that it has."""
    last = F.size("__w") - length
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get("__w", i + j) for j in range(length)]))
    return F.array_distinct(F.when(last >= 0, runs if known is None else F.filter(runs, lambda x: x.isin(known))))


def _short_contained(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``(__doc, item)`` of the items of one to four words and the documents in which these words follow one another."""
    short = materialize(items.filter(F.size("__w") < WORDS).select("item", F.size("__w").alias("n"), F.concat_ws(" ", "__w").alias("s")), "short")
    found = rows.select("__doc", F.lit(None).cast("bigint").alias("item")).limit(0)
    for r in short.groupBy("n").agg(F.count(F.lit(1)).alias("items")).orderBy("n").collect():  # four lengths at most
        own = short.filter(F.col("n") == r.n).select("item", "s")
        known = [x.s for x in own.select("s").distinct().collect()] if r["items"] <= IN_ROW else None
        each = rows.select("__doc", F.explode(_runs(r.n, known)).alias("__s"))
        met = each.join(broadcast_within(own, BROADCAST_ROWS), F.col("__s") == F.col("s")).select("__doc", "item")
        found = found.unionByName(met)
    return found.distinct()


def find_contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, item, matched, item_shingles, containment)`` for each document and item it contains.

    Null texts are empty and contain nothing. Rows that share an id are one document. Rows without id
    are not searched. Repeated items are found one by one. An item of fewer than five words is one
    shingle of all its words, found in every document in which they follow one another. Texts of any length are searched whole. Empty tables give no rows. Only the id
    and text columns are read, so other columns cannot clash.
    """
    every = materialize(_items(benchmark, item_col, item_text_col), "items")
    items = every.filter(F.size("__w") >= WORDS)
    index = materialize(sketches(items, threshold), "sketches")
    limits = index.groupBy("part").agg(F.max("h").alias("top"), F.min("need").alias("need")).collect()  # one row for each power of two
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__doc"), words(text_or_empty(text_col)).alias("__w")).filter("__doc is not null")
    size = F.greatest(F.size("__w") - (WORDS - 1), F.lit(1))
    top = F.greatest(*[F.when(size >= r.need, F.lit(r.top)).otherwise(F.lit(-(2**63))) for r in limits], F.lit(-(2**63)), F.lit(-(2**63)))
    sketch = F.array_distinct(F.filter(shingle_hashes(), lambda h: h <= F.col("__top")))
    probes = rows.select("__doc", size.alias("__n"), top.alias("__top"), "__w").select("__doc", "__n", F.explode(sketch).alias("__h"))
    met = probes.join(broadcast_within(index, BROADCAST_ROWS), (F.col("__h") == F.col("h")) & (F.col("__n") >= F.col("need")))
    candidates = materialize(met.select(F.col("__doc").alias("doc"), "item").distinct(), "candidates")

    wanted = materialize(candidates.select("doc").distinct(), "wanted")
    held = rows.join(broadcast_within(wanted, BROADCAST_ROWS), F.col("__doc") == F.col("doc"), "left_semi").select("__doc", F.explode(shingle_texts()).alias("__s"))
    asked = materialize(items.select("item", "q", F.explode(shingle_texts()).alias("s")), "item-shingles")
    common = held.join(broadcast_within(asked, BROADCAST_ROWS), F.col("__s") == F.col("s")).select("__doc", "item", "q", "s").distinct()  # a document may be several rows
    counted = common.groupBy("__doc", "item", "q").agg(F.count(F.lit(1)).alias("matched"))
    checked = counted.filter(F.col("matched") >= F.ceil(F.col("q") * threshold - 1e-9))
    out = checked.join(candidates.toDF("__d", "__i"), (F.col("__doc") == F.col("__d")) & (F.col("item") == F.col("__i")), "left_semi")
    one = F.lit(1).cast("bigint")
    out = out.select("__doc", "item", "matched", F.col("q").cast("bigint").alias("q")).unionByName(_short_contained(rows, every).select("__doc", "item", one.alias("matched"), one.alias("q")))
    return out.select(F.col("__doc").alias(id_col), F.col("item").alias(item_col), "matched", F.col("q").alias("item_shingles"), (F.col("matched") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay, rows without id too.

    Null and empty texts contain nothing; rows that repeat an id share its fate; columns may have any name.
    """
    losers = materialize(find_contained(docs, benchmark, id_col, text_col).select(id_col).distinct(), "leaks")
    return without_ids(docs, losers, id_col, BROADCAST_ROWS)


def op3_decontaminate(spark, sf_dir):
    """Every document and benchmark item that it contains."""
    return find_contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contained_sql(documents: str, benchmark: str) -> str:
    """SQL of the contained items by counting equal shingles of every document and item."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"
    shingles = "unnest(list_distinct(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))))"
    return f"""
    WITH items AS (SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT item_id, {split} AS w FROM {benchmark}) WHERE item_id IS NOT NULL AND len(w) > 0),
    asked AS (SELECT item_id, n, s, count(*) OVER (PARTITION BY item_id) AS q FROM (SELECT item_id, n, {shingles} AS s FROM items)),
    held AS (SELECT DISTINCT doc_id, n, {shingles} AS s FROM (SELECT doc_id, {split} AS w FROM {documents}), (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
    SELECT doc_id, item_id, count(*) AS matched, any_value(q) AS item_shingles, count(*) / any_value(q) AS containment
    FROM held JOIN asked USING (n, s) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(q) * 0.8 - 1e-9)"""


OP3_SQL = contained_sql("documents", "benchmark")
