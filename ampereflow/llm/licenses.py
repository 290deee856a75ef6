"""License scan: sparse TF-IDF cosine of headers and license files to templates, then inheritance by directory.

Three kinds of units of a file are compared: its lines, its blocks of lines (notices run over several),
and the whole file. All are weighed alike, by word frequencies over all lines of all files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, materialize, text_or_empty
from .license_texts import TEMPLATES

THRESHOLD = 0.8
#: Between blocks stand lines without letters and digits.
BETWEEN = r"\n[^\p{L}\p{N}\n]*\n"
#: A file is its directory's license file if its best unit holds at least this share of its words.
FILE_SHARE = 0.2
BROADCAST_ROWS = 200_000
#: Characters from which the registered query lays a document below its language.
SHORT = 400


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return files.select(F.col(f"`{id_col}`").alias("__id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("__line", "__s"))


def document_frequencies(lines: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all lines each word of the templates occurs, and the number of lines."""
    words = F.array_distinct(F.filter(tokens(F.col("__s")), lambda w: w.isin(vocabulary)))
    rows = lines.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a word
    counts = {r.t: r.n for r in rows}
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def template_weights(templates: list[tuple[str, str]], counts: dict[str, int], lines: int) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequencies of the words, and each template's vector divided by its length."""
    idf = {w: math.log((1 + lines) / (1 + n)) + 1 for w, n in counts.items()}
    vectors = []
    for words in template_words(templates):
        weights = {w: words.count(w) * idf[w] for w in words}
        length = math.sqrt(sum(x * x for x in weights.values()))
        vectors.append({w: x / length for w, x in weights.items()})
    return idf, vectors


def template_words(templates: list[tuple[str, str]]) -> list[list[str]]:
    return ["".join(c if c.isalnum() else " " for c in text.lower()).split() for _, text in templates]


def deciding_words(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a unit needs at least one to reach the threshold with any template.

    By Cauchy and Schwarz, a unit that shares only words outside this set has a cosine of at most the
    length of the template's vector on those words; the heaviest words are taken until that is too short.
    """
    chosen = set()
    for weights in vectors:
        rest = 1.0
        for word, x in sorted(weights.items(), key=lambda p: (-p[1], p[0])):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            chosen.add(word)
            rest -= x * x
    return sorted(chosen)


def reachable(words: Column, known: Column, vectors: list[dict[str, float]], idf: dict[str, float], unseen: float, threshold: float) -> Column:
    """Whether a unit of ``words``, of which ``known`` are in templates, can reach the threshold, told from its row alone.

    Its product with any template is at most the sum, over its words, of their weight times the largest
    share that a template gives them; its length is at least that of its words of no template, of which
    each weighs ``unseen`` or more. A unit with words of its own in plenty is told apart by that.
    """
    most = {w: x * max((v.get(w, 0.0) for v in vectors), default=0.0) for w, x in idf.items()}
    gains = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    product = F.aggregate(known, F.lit(0.0), lambda total, w: total + F.element_at(gains, w))
    return product >= (threshold - 1e-6) * unseen * F.sqrt(F.size(words) - F.size(known))


def _once(value: Column) -> Column:
    """``value`` computed once a row, however often it is used: a generated column is never put in place of its uses."""
    return F.explode(F.array(value))


def _units(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __unit, __s``: the lines, the blocks and the whole of each file with an id."""
    text = text_or_empty(text_col)
    units = F.concat(F.split(text, "\n"), F.split(text, BETWEEN), F.array(text))
    return files.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.posexplode(units).alias("__unit", "__s"))


def match_units(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, license, cosine, words)``: each file's best unit that reaches ``threshold`` with a template.

    A unit's vector is its word counts times inverse document frequencies taken over all lines of all
    files; a word of no template weighs as one that no line has. Only units with a deciding word that are
    ``reachable`` are weighed, and no unit that reaches the threshold is left out. Ties: the greater name, then the longer
    unit. ``words`` is the number of words of the unit. Texts of any length are compared whole.
    """
    spark = files.sparkSession
    lines = _lines(files, id_col, text_col)
    vocabulary = sorted({w for words in template_words(templates) for w in words})
    counts, total = document_frequencies(lines, vocabulary)
    idf, vectors = template_weights(templates, counts, total)
    deciding = deciding_words(vectors, threshold)
    unseen = math.log(1 + total) + 1
    worded = _units(files, id_col, text_col).select("__id", "__unit", _once(tokens(F.col("__s"))).alias("__w")).filter(F.exists("__w", lambda w: w.isin(deciding)))
    worded = worded.select("*", _once(F.filter("__w", lambda w: w.isin(vocabulary))).alias("__known"))
    likely = worded.filter(reachable(F.col("__w"), F.col("__known"), vectors, idf, unseen, threshold))
    terms = likely.select("__id", "__unit", F.explode("__w").alias("__t")).groupBy("__id", "__unit", "__t").agg(F.count(F.lit(1)).alias("tf"))
    weights = spark.createDataFrame([(w, x) for w, x in idf.items()], "t string, idf double")
    parts = spark.createDataFrame([(w, [(i, v[w]) for i, v in enumerate(vectors) if w in v]) for w in vocabulary], "v string, parts array<struct<i:int,x:double>>")
    names = F.array(*[F.lit(name) for name, _ in templates])
    known = terms.join(F.broadcast(weights), F.col("__t") == F.col("t"), "left").join(F.broadcast(parts), F.col("__t") == F.col("v"), "left")  # a few words of the templates
    weight = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    weighed = materialize(known.select("__id", "__unit", "tf", weight.alias("w"), "parts"), "weighed")
    norms = weighed.groupBy("__id", "__unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = weighed.select("__id", "__unit", "w", F.explode("parts").alias("p")).groupBy("__id", "__unit", F.col("p.i").alias("i")).agg(F.sum(F.col("w") * F.col("p.x")).alias("dot"))
    cosines = dots.join(norms, ["__id", "__unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= threshold)
    best = cosines.groupBy("__id").agg(F.max(F.struct("cosine", F.get(names, F.col("i")).alias("license"), "words")).alias("b"))
    return best.select(F.col("__id").alias(id_col), F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), F.col("b.words").alias("words"))


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the root (the empty text) included."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def inherit(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files (id, dir)`` with the license of the nearest directory above that has one.

    ``sources (dir, license, from_id)`` has each directory once. Each different directory is resolved
    once by joining its ancestors, so one that holds a third of all files is one row of the search. The
    answers are written, and files join them by a broadcast of bounded size or in a join that Spark can split.
    """
    wanted = files.select("dir").distinct().select("dir", F.explode(_ancestors(F.col("dir"))).alias("up"))
    nearest = wanted.join(sources.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "from_id"), F.length("up")).alias("found"))
    nearest = broadcast_within(materialize(nearest, "nearest"), BROADCAST_ROWS)
    return files.join(nearest, "dir", "left").select("id", F.col("found.license").alias("license"), F.col("found.from_id").alias("from_id"))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """License of each file: the id, ``license, how, cosine, from_id``.

    ``how`` is ``header`` for a file whose own best unit reaches the threshold, ``inherited`` for one
    that takes it from the nearest directory above with a license file, else null like the license. A
    license file is one named LICENSE, COPYING, NOTICE or UNLICENSE, or whose best unit (line, block or whole) holds at least
    ``file_share`` of its words; of several in a directory the greatest cosine, then the smallest id
    counts. Null texts are empty; a null path is the root directory. Files that share an id pool their
    units. Rows without id get a row without license of their own, and may inherit. An empty table gives no rows.
    """
    found = materialize(match_units(files, templates, id_col, text_col, threshold), "licenses")
    path = F.coalesce(F.col(f"`{path_col}`"), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    listed = files.select(F.col(f"`{id_col}`").alias("id"), folder.alias("dir"), F.element_at(F.concat(F.array(F.lit("")), parts), -1).alias("name"))
    own = listed.join(found.withColumnRenamed(id_col, "__id"), F.col("id") == F.col("__id"), "left").select("id", "dir", "name", "license", "cosine", "words")
    keyed = broadcast_within(found.select(F.col(id_col).alias("__id")), BROADCAST_ROWS)
    sizes = files.join(keyed, files[id_col] == keyed["__id"], "left_semi").groupBy(F.col(f"`{id_col}`").alias("__k")).agg(F.sum(F.size(tokens(text_or_empty(text_col)))).alias("all_words"))
    named = F.col("name").rlike(r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$")
    holders = own.filter("license is not null").join(sizes, F.col("id") == F.col("__k")).filter(named | (F.col("words") >= file_share * F.col("all_words")))
    sources = holders.groupBy("dir").agg(F.max_by(F.struct("license", F.col("id").alias("from_id")), F.struct("cosine", -F.col("id"))).alias("s")).select("dir", "s.license", "s.from_id")
    sources = materialize(sources, "license-files")
    direct = own.filter("license is not null").select("id", "license", F.lit("header").alias("how"), "cosine", F.col("id").alias("from_id"))
    others = inherit(own.filter("license is null").select("id", "dir"), sources)
    indirect = others.select("id", "license", F.when(F.col("license").isNotNull(), "inherited").alias("how"), F.lit(None).cast("double").alias("cosine"), "from_id")
    return direct.unionByName(indirect).withColumnRenamed("id", id_col)


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: short ones lie in the directory of their source, others in one of ten below its language."""
    below = F.when(F.length(F.coalesce("text", F.lit(""))) >= SHORT, F.concat_ws("/", "lang", (F.abs("doc_id") % 10).cast("string")))
    return docs.select("doc_id", "text", F.concat_ws("/", "source", below, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or that of the nearest directory above it."""
    return scan_licenses(with_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("cosine", F.round("cosine", 4))


def licenses_sql(templates: list[tuple[str, str]]) -> str:
    """SQL of the same result that weighs every unit with a word of a template."""
    words = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    return f"""
    WITH t AS (SELECT i, name, unnest({words.format('s')}) AS w FROM (VALUES {values}) v(i, name, s)),
    d AS (SELECT doc_id, concat_ws('/', source, CASE WHEN length(coalesce(text, '')) >= {SHORT} THEN concat_ws('/', lang, CAST(abs(doc_id) % 10 AS VARCHAR)) END) AS dir, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d)),
    u AS (SELECT doc_id, unnest(range(len(p))) AS unit, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) || string_split_regex(text, '{BETWEEN}') || [text] AS p FROM d)),
    lw AS (SELECT DISTINCT doc_id, line, w FROM (SELECT doc_id, line, unnest({words.format('s')}) AS w FROM l) WHERE w IN (SELECT w FROM t)),
    n AS (SELECT count(*) AS n FROM l),
    df AS (SELECT w, count(*) AS c FROM lw GROUP BY w),
    idf AS (SELECT w, ln((1 + n) / (1 + coalesce(c, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM t) LEFT JOIN df USING (w), n),
    tv AS (SELECT i, name, w, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS x FROM (SELECT i, name, w, count(*) * any_value(idf) AS x FROM t JOIN idf USING (w) GROUP BY i, name, w)),
    uw AS (SELECT doc_id, unit, unnest({words.format('s')}) AS w FROM u),
    lt AS (SELECT doc_id, unit, w, count(*) AS tf FROM uw WHERE (doc_id, unit) IN (SELECT (doc_id, unit) FROM uw WHERE w IN (SELECT w FROM t)) GROUP BY ALL),
    wt AS (SELECT doc_id, unit, w, tf, tf * coalesce(idf, ln(1 + n) + 1) AS x FROM lt LEFT JOIN idf USING (w), n),
    nm AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm, sum(tf) AS words FROM wt GROUP BY ALL),
    cs AS (SELECT doc_id, name, round(sum(wt.x * tv.x) / any_value(norm), 6) AS cosine, any_value(words) AS words FROM wt JOIN tv USING (w) JOIN nm USING (doc_id, unit) GROUP BY doc_id, unit, i, name),
    best AS (SELECT doc_id, name AS license, cosine, words FROM cs WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, name DESC, words DESC) = 1),
    files AS (SELECT doc_id, dir, license, cosine FROM best JOIN d USING (doc_id) WHERE words >= {FILE_SHARE} * len({words.format('text')})),
    src AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id) = 1),
    up AS (SELECT DISTINCT dir, unnest(list_transform(range(0, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) AS above FROM d),
    near AS (SELECT up.dir, src.license, src.doc_id AS from_id FROM up JOIN src ON src.dir = up.above QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(above) DESC) = 1)
    SELECT d.doc_id, coalesce(best.license, near.license) AS license, CASE WHEN best.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' END AS how,
        round(best.cosine, 4) AS cosine, CASE WHEN best.license IS NOT NULL THEN d.doc_id ELSE near.from_id END AS from_id
    FROM d LEFT JOIN best USING (doc_id) LEFT JOIN near ON d.dir = near.dir"""


OP10_SQL = licenses_sql(TEMPLATES)
