"""Personal data by bootstrapped contextual extraction.

Fixed patterns find seed entities. The words around a seed are a lexical pattern; patterns and the
strings found in their slots (instances) form a bipartite graph. Spark scores both sides in turn:
a pattern by how much of what stands in its slots is known to be of its kind, an instance by the
patterns that hold it. Patterns of high confidence then discover identifiers that no fixed pattern
matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256
from itertools import accumulate
from typing import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, drop_table, materialize, text_or_empty

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time: a run of digits is tried once, from its start, and never given back.
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()} | {"ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: Words before ``=`` or ``:`` after which a long value with a digit is a seed of the fifth kind.
SECRET_KEYS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "secret_key", "private_key", "auth_token", "access_token")
SECRET = "secret"
_SECRET = re.compile(r"(?=[^0-9]*[0-9])[A-Za-z0-9+/_.-]{16,}={0,2}")
_WORD = re.compile(r"\S+")
_MARK = re.compile("[0-9@]")
_KEY = re.compile(r"[\"'(\[{<]*([A-Za-z_][A-Za-z0-9_.-]*)[\"']?([=:])[\"']?")
_ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)[\"']?\s*[=:]\s*[\"']?$")
_MARKED_OUT = re.compile(r"[^\w\s]")
_RUNS = re.compile("[^\\W\\d_]+|[0-9]+")
_EDGE = "\"'.,;:!?()[]{}<>*%&$#|="
#: Most words of a candidate; a longer run of words gives its words one by one.
JOIN_WORDS = 6
#: Characters from which a word of a context or an instance stands by its digest, so that keys are short.
DIGEST_FROM = 48
#: Different seeds that a pattern needs, the confidence from which it discovers, and rounds of scoring.
MIN_SEEDS, CONFIDENCE, ROUNDS = 4, 0.8, 3
#: Score of unknown instances to begin with, and the score to which means are pulled by one.
PRIOR = 0.1
#: Most patterns that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the email pattern, found from each at sign outwards in linear time."""
    end = 0
    for m in re.finditer("@", text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, m.end())
        if m.start() >= end and start < m.start() and domain:
            end = domain.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` of what the fixed patterns match and their checks confirm, in order."""
    found = []
    digits = re.search("[0-9]", text) is not None
    for k, kind in enumerate(KINDS):
        if not ("@" in text if kind == "email" else digits and (kind != "phone" or "+" in text)):
            continue
        if kind == "email":
            found += [(k, a, b) for a, b in emails(text)]
            continue
        for m in _COMPILED[kind].finditer(text):
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group(0).split("."))
            elif kind == "card":
                number = re.sub("[ -]", "", m.group(0))
                good = 13 <= len(number) <= 19 and luhn(number)
            else:
                good = 9 <= len(re.sub("[^0-9]", "", m.group(0))) <= 15
            if good:
                found.append((k, m.start(), m.end()))
    return found


def refuted(text: str) -> str | None:
    """The kind whose pattern a whole string matches but whose check it fails; it is never of that kind."""
    for kind in ("ip", "card", "phone"):
        if _COMPILED[kind].fullmatch(text):
            return None if base_spans(text) else kind
    return None


def _short(text: str) -> str:
    return text if len(text) < DIGEST_FROM else sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and (text[s] in _EDGE or text[s].isspace()):
        s += 1
    while e > s and (text[e - 1] in _EDGE or text[e - 1].isspace()):
        e -= 1
    return s, e


def shapes(text: str) -> tuple[str, str]:
    """How a string is spelt: letters as ``a`` and digits as ``9``; digits one by one, and runs as one."""
    fine = _RUNS.sub(lambda m: "9" * len(m.group(0)) if m.group(0)[0] <= "9" else "a", text)
    return _short(fine), _short(re.sub("9+", "9", fine))


def _candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates of neighbouring words: first what is well formed as a kind, then the parts between.

    A match of a fixed pattern that runs into the next number fails its check and is dropped; here the
    longest join of words that passes a check is a candidate by itself, and so is what is left around
    it. A part of more than ``JOIN_WORDS`` words gives its words.
    """
    at, rest = 0, 0
    while at <= len(words):
        size = 0
        if at < len(words):
            for n in range(min(JOIN_WORDS, len(words) - at), 0, -1):
                s, e = _trimmed(text, words[at][0], words[at + n - 1][1])
                if [(s, e)] == [(s + a, s + b) for _, a, b in base_spans(text[s:e])]:
                    size = n
                    break
        if size or at == len(words):
            part = words[rest:at]
            for group in [part] if 0 < len(part) <= JOIN_WORDS else [[w] for w in part]:
                yield _trimmed(text, group[0][0], group[-1][1])
            if size:
                yield _trimmed(text, words[at][0], words[at + size - 1][1])
            rest = at + size
        at += size or 1


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """``(kind or None, not_kind or None, start, end, instance, patterns)`` of seeds and of other candidates.

    A candidate is made of words with a digit or an at sign, joined over single spaces, without
    punctuation at its ends, of four characters or more. Seeds cut it, and so does a key with ``=`` or
    ``:`` at the start of a word. ``patterns`` are what stands around it: two words and one word to the
    left (``^`` at the start of a line), one word to the right, both neighbours, the key before it; and
    how it is spelt, if it has any sign. Words and candidates may have any length.
    """
    out: list[tuple] = []
    if not spans and not _MARK.search(text):
        return out
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [s for s, _ in words]
    places = [(s, e, KINDS[k]) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    cut_starts, cut_ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    runs: list[list[tuple[int, int]]] = []
    for s, e in words:
        if not _MARK.search(text, s, e):
            continue
        key = _KEY.match(text, s, e)
        begin = key.end() if key and key.end() < e and not text.startswith("//", key.end()) else s
        parts, at = [], begin
        for i in range(max(bisect_right(cut_starts, begin) - 1, 0), len(cut_starts)):
            if cut_starts[i] >= e:
                break
            if cut_ends[i] > begin:
                parts.append((at, cut_starts[i]))
                at = max(at, cut_ends[i])
        parts.append((at, e))
        for i, (a, b) in enumerate(parts):
            if a >= b or not _MARK.search(text, a, b):
                continue
            joins = runs and i == 0 and a == s and runs[-1][-1][1] + 1 == s and text[s - 1] == " "
            (runs[-1].append if joins else lambda w: runs.append([w]))((a, b))
    for run in runs:
        places += [(s, e, None) for s, e in _candidates(text, run) if e - s >= 4 and _MARK.search(text, s, e)]
    side = lambda a, b: _short(text[a:b].lower().strip(_EDGE))
    for s, e, kind in places:
        first = bisect_right(starts, s) - 1
        before = [(a, side(a, min(b, s))) for a, b in words[max(first - 5, 0) : first + 1] if a < s]
        before = [(a, name) for a, name in before if name][-2:]
        next_word = max(bisect_right(starts, e) - 1, 0)
        after = [side(max(a, e), b) for a, b in words[next_word : next_word + 5] if b > e]
        one, two = before[-1][1] if before else "^", before[0][1] if len(before) > 1 else "^"
        right = next(filter(None, after), "$")
        near = text[max(before[-1][0], s - 4 * DIGEST_FROM) : s] if before else ""
        if "\n" in near:
            one, two, near = "^", "^", ""
        key = _ASSIGNED.search(near)
        key = key.group(1).lower() if key else None
        found = text[s:e]
        if kind is None and key in SECRET_KEYS and _SECRET.fullmatch(found):
            kind = SECRET
        patterns = [f"L1 {one}", f"L2 {two} {one}", f"R1 {right}", f"B {one} _ {right}"] + ([f"K {_short(key)}"] if key else [])
        if kind != SECRET and _MARKED_OUT.search(found):
            patterns += [f"S {shapes(found)[0]}", f"T {shapes(found)[1]}"]
        out.append((kind, None if kind else refuted(found), s, e, _short(found.lower()), patterns))
    return out


NEAR = ["kind", "not_kind", "start", "end", "instance", "patterns"]
_NEAR = pa.list_(pa.struct(list(zip(NEAR, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]))))
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = "array<struct<kind:int,start:bigint,end:bigint>>"


def _marker(hide: int):
    """An Arrow function from ``(id, text)`` to ``(id, base, near)``; of every ``hide`` seeds one is left unmarked."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, near = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                shown = [x for x in spans if not hide or crc32(text[x[1] : x[2]].lower().encode()) % hide]
                base.append([dict(zip(("kind", "start", "end"), x)) for x in spans])
                near.append([dict(zip(NEAR, o)) for o in occurrences(text, shown)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(near, _NEAR)], names=["id", "base", "near"])

    return found


def score_patterns(edges: DataFrame, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, kind, confidence)`` from the graph ``edges (pattern, instance, kind, not_kind)``.

    ``edges`` has each pattern and instance once, however often they occur and in however many copies
    of a text; ``kind`` is null for an instance that no seed is, ``not_kind`` is the kind that it can't be.
    A pattern needs ``min_seeds`` different seeds of its kind. Its confidence is the mean score, for that
    kind, of all instances in its slots, pulled to ``PRIOR`` by one: a seed of the kind counts one, a
    seed of another kind and an instance that can't be of the kind nothing, and an unknown instance the
    mean confidence of its patterns for the kind, pulled likewise. Patterns of too few seeds are left out
    before anything is joined; repeats are aggregated before each shuffle.
    """
    seeds = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= min_seeds)
    seeds = materialize(seeds, "seeds")
    held = edges.filter("kind is null").join(broadcast_within(seeds.select("pattern", F.col("kind").alias("as")), BROADCAST_ROWS), "pattern")
    unknown = materialize(held.filter("not_kind is null or not_kind <> as").select("pattern", "instance", "as"), "unknown")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    asked = unknown.groupBy("pattern", F.col("as").alias("kind")).agg(F.count(F.lit(1)).alias("open"))
    patterns = seeds.join(sizes, "pattern").join(asked, ["pattern", "kind"], "left").withColumn("open", F.coalesce("open", F.lit(0)))
    mean = lambda gained: (F.col("seeds") + gained + PRIOR) / (F.col("n") + 1)
    patterns = materialize(patterns.withColumn("confidence", mean(PRIOR * F.col("open"))), "patterns")
    for _ in range(rounds):
        known = patterns.select("pattern", F.col("kind").alias("as"), "confidence")
        instances = unknown.join(known, ["pattern", "as"]).groupBy("instance", "as").agg(((F.sum("confidence") + PRIOR) / (F.count(F.lit(1)) + 1)).alias("score"))
        gained = unknown.join(instances, ["instance", "as"]).groupBy("pattern", F.col("as").alias("kind")).agg(F.sum("score").alias("gained"))
        step = patterns.drop("confidence").join(gained, ["pattern", "kind"], "left").withColumn("confidence", mean(F.coalesce("gained", F.lit(0.0)))).drop("gained")
        step = materialize(step, "patterns")
        drop_table(patterns)
        patterns = step
    return patterns.select("pattern", "kind", "confidence")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, hide: int = 0) -> DataFrame:
    """For each row: the id, ``base`` and ``found``, arrays of ``struct<kind, start, end>`` in code points.

    ``base`` is what the fixed patterns match, by kind and start. ``found`` is what patterns of at least
    ``confidence`` discover besides, kind 4 being secrets; it never overlaps ``base``, and its spans never
    overlap each other. Only contexts and instances are shuffled, never texts; repeats are counted once
    before the graph is joined, so copies of a text weigh as one. Texts are searched whole, whatever their
    length. Null and empty texts have two empty arrays, and so have all rows of a table without seeds.
    Rows that share an id share the discoveries of places that they have in common. Other columns are
    not read. With ``hide`` n every nth seed, by a hash of its text, is treated as unknown, and ``found``
    may hold it: a measure of what the contexts find.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, base {_SPAN_TYPE}, near array<struct<kind:string,not_kind:string,start:bigint,end:bigint,instance:string,patterns:array<string>>>"
    marked = materialize(rows.mapInArrow(_marker(hide), schema), "marked")
    near = marked.select("id", F.explode("near").alias("o")).select("id", "o.*")
    placed = near.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = materialize(placed.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.min("not_kind").alias("not_kind")), "edges")
    strong = materialize(score_patterns(edges, min_seeds).filter(F.col("confidence") >= confidence), "strong")
    open_places = placed.filter(F.col("kind").isNull() | (F.col("kind") == SECRET)).select("id", "start", "end", "pattern", "kind", "not_kind")
    fits = open_places.join(broadcast_within(strong.withColumnRenamed("kind", "as"), BROADCAST_ROWS), "pattern").filter("coalesce(kind, as) = as and (not_kind is null or not_kind <> as)")
    spans = fits.groupBy("id", "start", "end").agg(F.max_by("as", F.struct("confidence", "as")).alias("as"))
    code = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("as")).cast("int") - 1
    grouped = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(code.alias("kind"), "start", "end"))).alias("found"))
    out = marked.select("id", "base").join(grouped, "id", "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("found", F.array().cast(_SPAN_TYPE)).alias("found"))


def hidden_recall(docs: DataFrame, hide: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(kind, hidden, recalled, found)``: how many of the hidden seeds the contexts find again.

    Every ``hide``th seed is hidden. ``found`` counts all discoveries of the kind, so that recalled / found
    is a lower bound of the precision.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).dropDuplicates(["id"])
    every = find_personal_data(rows, "id", "text", hide=hide).join(rows, "id")
    span = lambda x: F.struct("id", x["kind"].alias("kind"), F.substring("text", x["start"] + 1, x["end"] - x["start"]).alias("s"), x["start"].alias("start"))
    seeds = every.select(F.explode(F.transform("base", span)).alias("x")).select("x.*").filter(F.crc32(F.encode(F.lower("s"), "UTF-8")) % hide == 0)
    found = every.select(F.explode(F.transform("found", span)).alias("x")).select("x.*")
    both = seeds.withColumn("seed", F.lit(1)).join(found.withColumn("hit", F.lit(1)), ["id", "kind", "start", "s"], "full_outer")
    again = F.count(F.when((F.col("seed") == 1) & (F.col("hit") == 1), 1))
    return both.groupBy("kind").agg(F.count("seed").alias("hidden"), again.alias("recalled"), F.count("hit").alias("found"))


def _joined(spans):
    name = F.array(*map(F.lit, (*KINDS, SECRET)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """Counts and digest are of the fixed patterns' spans; ``spans`` has the discovered ones of the four kinds too, ``secrets`` those of secrets."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    secret = len(KINDS)
    every = F.array_sort(F.concat("base", F.filter("found", lambda s: s["kind"] < secret)))
    secrets = F.array_sort(F.filter("found", lambda s: s["kind"] == secret))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), _joined(secrets).alias("secrets"))
