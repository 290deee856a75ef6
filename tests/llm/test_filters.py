import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampereflow.llm import common, decontaminate, language, license_texts, licenses, pii, quality, toxicity, url_filter


# --- op3

def shingles(text, size=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def own_shingles(text):
    """An item's shingles: of five words, or of all its words if it has fewer."""
    return shingles(text, max(1, min(5, len(re.findall(r"[^\W_]+", (text or "").lower())))))


@pytest.mark.parametrize("in_row", [1000, 0])
def test_containment_matches_brute_force(spark, monkeypatch, in_row):
    monkeypatch.setattr(decontaminate, "IN_ROW", in_row)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 14, 33, 70])))) for i in range(25)] + [(90, ""), (91, None), (92, "same Words here, twice over."), (93, "same words here twice over"), (94, "w7 w8"), (95, "W7"), (96, "words here -- twice"), (97, "w7"), (None, "a b c d e f"), (None, "w1")]
    docs = [(1, None), (2, ""), (3, "same words HERE -- twice\nover and on"), (None, items[5][1])]
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 10, 400]))]
        passage = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage[rng.randrange(len(passage))] = "zz"
        at = rng.randrange(len(text) + 1)
        docs.append((10 + k, " ".join(text[:at] + passage + text[at:])))
    docs.append((10, "more of document ten " + items[3][1]))
    expected = set()
    pooled = {}
    for d, t in docs:
        if d is not None:
            pooled.setdefault(d, set()).update(*[shingles(t, n) for n in range(1, 6)])
    for d, s in pooled.items():
        for i, t in items:
            q = own_shingles(t)
            if i is not None and q and len(q & s) >= 0.8 * len(q) - 1e-9:
                expected.add((d, i, len(q & s), len(q)))
    documents = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id bigint, text string, item string, q int")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contained(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.item_shingles) for r in found} == expected and len(found) == len(expected)
    kept = decontaminate.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    bad = {d for d, *_ in expected}
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((d or 0) for d, _ in docs if d is None or d not in bad)
    assert decontaminate.find_contained(documents.limit(0), benchmark).count() == 0
    assert decontaminate.find_contained(documents, benchmark.limit(0)).count() == 0


# --- op4 and op1

def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    words = ["plain", "river", "stone", "walk", "green", "window", "table"]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(30)] = "grumf" + rng.choice(["", "ing", "ed"])
        docs.append((i, " ".join(text), 0.5))
        labels.append((i, int(bad)))
    docs += [(1000, None, 0.1), (1001, "", 0.1), (1002, "river " * 300_000 + "GRUMFED!", 0.1), (None, "grumf", 0.1)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    labelled = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_registered(documents, labelled)
    found = {r.doc_id: r.score for r in toxicity.score_documents(documents, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert all((found[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert found[1000] == found[1001] < 0.7 < found[1002]
    kept = toxicity.drop_toxic(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} >= {1000, 1001, 1}
    assert 1002 not in {r.doc_id for r in kept.collect()}
    assert toxicity.score_documents(documents.limit(0), model).count() == 0
    neutral = toxicity.fit(documents, labelled.limit(0))
    assert neutral.score("anything") == pytest.approx(0.5)


def test_long_texts_have_the_same_features_as_their_pieces(monkeypatch):
    text = "ab cdé " * 50
    whole = sorted(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "_PIECE", 16)
    assert sorted(toxicity.features(text).tolist()) == whole
    known = np.zeros(1 << toxicity.BITS, bool)
    known[[f for f in whole if f < len(known)][::2]] = True
    assert sorted(toxicity.features(text, known).tolist()) == [f for f in whole if known[f % len(known)]]


def test_toxicity_fit_matches_brute_force(spark):
    """The kept features, their ratios and the fitted weights against plain sets and Newton's method."""
    import math

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) + (" vexing" if i % 3 == 0 else "") + (" alpha" if i % 2 else ""), i % 3 == 0) for i in range(150)]
    docs += [(i, t, y) for i, t, y in docs[:9]]  # repeated rows count as often as they occur
    documents = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in docs[:150]], "doc_id bigint, toxic int")
    model = toxicity.fit(documents, labels, least_z=2.0)
    held = [set(toxicity.features(t).tolist()) for _, t, _ in docs]
    pos = sum(y for *_, y in docs)
    neg = len(docs) - pos
    ratios = {}
    for f in set().union(*held):
        a, b = sum(f in s for s, (*_, y) in zip(held, docs) if y), sum(f in s for s, (*_, y) in zip(held, docs) if not y)
        share = (a + b) / len(docs)
        if share < 1 and abs(a / pos - b / neg) >= 2.0 * math.sqrt(share * (1 - share) * (1 / pos + 1 / neg)):
            ratios[f] = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
    assert model.ids.tolist() == sorted(ratios)
    place = {f: i for i, f in enumerate(sorted(ratios))}
    x = np.zeros((len(docs), len(ratios) + 1))
    x[:, -1] = 1
    for row, s in zip(x, held):
        for f in s & set(place):
            row[place[f]] = ratios[f]
    y = np.array([float(v) for *_, v in docs])
    weight = np.where(y > 0, neg / pos, 1.0)
    penalty = np.append(np.full(len(ratios), toxicity.PENALTY), 0.0)
    w = np.zeros(len(ratios) + 1)
    loss = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (penalty * w * w).sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = x.T @ ((weight * p * (1 - p))[:, None] * x) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    r = np.array([ratios[f] for f in sorted(ratios)])
    got = np.append(model.values / r, model.bias)
    assert loss(got) - loss(w) <= 0.01 * len(docs)  # the descent stops early
    for text in (docs[0][1], docs[1][1], "", "vexing"):
        margin = model.bias + sum(dict(zip(model.ids.tolist(), model.values.tolist())).get(f, 0) for f in toxicity.features(text).tolist())
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)


def test_samples_are_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i else 5000)) for i in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    take = lambda rows, chars: common.labelled_sample(docs, labels, "doc_id", "text", "toxic", rows, chars).collect()
    assert len(take(1000, 1 << 20)) == 100 and len(take(30, 1 << 20)) == 30
    assert len(take(1000, 640)) == 64 and all(len(r.text) == 10 for r in take(1000, 640))


def test_quality_votes(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        junk = i % 4 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words).capitalize() + ".", "c"))
        labels.append((i, 0 if junk else 1))
    docs += [(1000, None, "c"), (1001, "", "c"), (None, "ab cd.", "c")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, basis string")
    model = quality.fit(documents, spark.createDataFrame(labels + [(None, 1)], "doc_id bigint, quality int").filter("coalesce(doc_id % 3, 0) <> 0"))
    rows = quality.score_documents(documents, model).collect()
    found = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all((found[i] >= 0.3) == (i % 4 != 0) for i in range(0, 300, 3))
    assert found[1000] == found[1001] == model.prior
    assert quality.score_documents(documents.limit(0), model).count() == 0
    nothing = quality.fit(documents, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert nothing.score(["a b c"])[0] == 0.5


def test_quality_tells_texts_by_their_words(spark):
    """Both classes have the same letters and shapes; only the words differ, and ties and repeats do no harm."""
    rng = random.Random(8)
    good, bad = ["stone", "river", "cloud", "plant"], ["notes", "viver", "could", "plate"]
    docs = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(30))) for i in range(200)]
    documents = spark.createDataFrame(docs + docs[:5] + [(900, "stone river " * 200_000)], "doc_id bigint, text string")
    model = quality.fit(documents, spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in docs if i % 3], "doc_id bigint, quality int"))
    found = quality.score_documents(documents, model).collect()
    assert len(found) == 206 and all((r.score >= 0.3) == (r.doc_id == 900 or r.doc_id % 4 > 0) for r in found)


def test_latent_basis_spans_the_leading_singular_vectors():
    rng = np.random.default_rng(4)
    dense = (rng.random((600, 40)) * (rng.random((600, 40)) < 0.3) * np.linspace(9, 0.1, 40)).astype(np.float32)
    row, column = np.nonzero(dense)
    x = quality.Sparse(column, dense[row, column], np.cumsum([0, *(dense != 0).sum(1)]), 40)
    assert np.allclose(x.times(np.eye(40, dtype=np.float32)), dense) and np.allclose(x.back(dense), dense.T @ dense, rtol=1e-4, atol=1e-3)
    basis = quality.latent_basis(x, 5)
    _, _, v = np.linalg.svd(dense)
    assert np.linalg.norm(dense @ basis) >= 0.99 * np.linalg.norm(dense @ v[:5].T)


def test_blocked_cosines_are_exact(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    basis = rng.standard_normal((50, 8)).astype(np.float32)
    place = np.full(quality.TERMS, -1, np.int32)
    place[rng.choice(quality.TERMS, 50, replace=False)] = np.arange(50)
    place[(1 * 32 + 1) * 32 + 1] = 0
    place[quality.term_counts("abc def")[0]] = np.arange(len(quality.term_counts("abc def")[0]))
    near = rng.standard_normal((40, 8)).astype(np.float32)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    model = quality.Model(place, basis, near, (np.arange(40) % 2).astype(float), 0.5)
    texts = ["abc def", "", "zzz aaa bbb", "q"]
    once = model.score(texts)
    monkeypatch.setattr(quality, "_BLOCK", 1)
    assert np.allclose(once, model.score(texts))
    z = model.vectors([quality.term_counts(texts[0])])[0]
    order = np.argsort(-(near @ z))[: quality.NEIGHBOURS]
    weight = np.maximum((near @ z)[order], 0) ** quality.SHARPNESS
    assert once[0] == pytest.approx(float((weight * model.labels[order]).sum() / weight.sum()), abs=1e-5)


# --- op2

def test_language_fusion(spark):
    docs = [(i, ("the house and the river " if i % 2 else "das haus und der fluss ") * 20, "en" if i % 2 else "de") for i in range(60)] + [(None, "x", "en"), (99, "y", None)]
    langs, model = language.fit_text_model(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert langs == ["de", "en"]
    page = lambda t, lang="": f"<html{' lang=' + lang if lang else ''}><script>the the</script><!-- the --><p>{t}</p></html>"
    rows = [(i, f"https://www.a.de/{i}", page("das haus und der fluss", "de-AT")) for i in range(40)]
    rows += [(i, f"https://b.example.com/{i}", page("the river and the house", "EN")) for i in range(40, 80)]
    rows += [(100, "https://www.a.de/x", page("")), (101, "https://b.example.com/y", None), (102, None, page("the house and the river")), (103, "", ""), (104, "https://new.de/", page("", "de")), (None, "nonsense", page("das haus")), (105, "https://www.a.de/", page("the house and the river " * 200))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, host string")
    found = {r.page_id: r for r in language.identify(pages, langs, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang == ("de" if i < 40 else "en") for i in range(80))
    assert found[100].lang == "de" and found[101].lang == "en" and found[102].lang == "en" and found[104].lang == "de"
    assert found[105].lang == "en" and found[None].lang == "de"
    assert found[0].declared == "de" and found[100].declared is None and 0.5 < found[0].probability <= 1
    assert language.identify(pages.limit(0), langs, model).count() == 0
    assert language.identify(pages, [], model).filter("lang is not null").count() == 0


def test_host_shares_are_smoothed_down_the_levels(spark):
    """The posterior of pages without text and markup by hand."""
    import math

    import numpy as np

    rows = [(i, "https://x.a.de/", "<p>d</p>") for i in range(3)] + [(9, "https://y.a.de/", "")]
    model = np.zeros((2, 1 << language.BITS), np.float32)
    model[0] += 1e-3  # every text leans to the first language, and so does an empty one by name
    found = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ["de", "en"], model).collect()}
    glob = (3 + 0.5) / (4 + 1)
    domain = (3 + 5 * glob) / (3 + 5)
    host = (0 + 5 * domain) / (0 + 5)
    suffix = (3 + 5 * glob) / (3 + 5) / glob
    other_glob = 0.5 / 5
    other_domain = 5 * other_glob / 8
    other = other_domain * (5 * other_glob / 8 / other_glob)
    mine = host * suffix * math.exp(float(model[0, 0]) * language.grams(" ").sum())
    assert found[9].probability == pytest.approx(mine / (mine + other), rel=1e-3)


def test_unclosed_tags_take_linear_time():
    import time

    for page in ("<script>" * 130_000, "<!--" * 260_000, "<style a" * 130_000, "<" * 1_000_000, "<html lang" * 100_000):
        began = time.time()
        language.visible_text(page)
        assert time.time() - began < 5
    assert language.visible_text("a<!-- b <i>c</i> d") == "a c  d" and language.visible_text("1 < 2 &amp; <b>x</b>") == "1  x " and language.visible_text("<script>x</script>y<style>z</STYLE >w") == " y w"


def test_fusion_matches_brute_force_on_whole_pages(spark):
    import math
    from collections import Counter, defaultdict

    rng = random.Random(9)
    vocabulary = {"de": "der haus fluss und nicht wald".split(), "en": "the house river and not wood".split()}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(40)), lang) for i in range(40) for lang in ("de", "en")], "doc_id bigint, text string, lang string")
    langs, model = language.fit_text_model(docs)
    pages = []
    for i in range(90):
        lang = rng.choice(langs)
        host = rng.choice(["a.x.de", "b.x.de", "c.org", "d.y.org", ""])
        text = " ".join(rng.choice(vocabulary[lang if rng.random() < 0.7 else rng.choice(langs)]) for _ in range(rng.choice([0, 1, 2, 30])))
        mark = rng.choice(["", f" lang='{lang}'", ' class="k" lang=fr-CA'])
        pages.append((i, f"http://{host}/{i}" if host else None, f"<html{mark}><p>{text}</p>"))
    pages += [pages[3], pages[4]]
    likelihood = {}
    for i, _, page in pages:
        counts = language.grams(language.visible_text(page))
        likelihood[i] = [float(model[k] @ counts) * language.EFFECTIVE / max(counts.sum(), language.EFFECTIVE) for k in range(2)]
    best = {i: max(range(2), key=lambda k: (likelihood[i][k], -k)) for i in likelihood}
    place = lambda url: re.match("http://([^/]*)", url).group(1) if url else ""
    mark_of = lambda page: (re.search(r"<html[^>]*\slang=['\"]?([a-z]+)", page) or [None, ""])[1]
    keys = {"host": lambda p: place(p[1]), "domain": lambda p: ".".join(place(p[1]).split(".")[-2:]), "suffix": lambda p: place(p[1]).split(".")[-1], "declared": lambda p: mark_of(p[2])}
    tallies = {name: defaultdict(Counter) for name in keys}
    for p in pages:
        for name, key in keys.items():
            tallies[name][key(p)][best[p[0]]] += 1
    everything = Counter(best[p[0]] for p in pages)
    found = defaultdict(list)
    for r in language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), langs, model).collect():
        found[r.page_id].append(r)
    for p in pages:
        less = lambda c: [c[k] - (k == best[p[0]]) for k in range(2)]
        glob = [(n + language.ADDED) / (len(pages) + 2 * language.ADDED) for n in less(everything)]
        smooth = lambda name, above: [(n + language.PRIOR_WEIGHT * a) / (sum(less(tallies[name][keys[name](p)])) + language.PRIOR_WEIGHT) for n, a in zip(less(tallies[name][keys[name](p)]), above)]
        prior = smooth("host", smooth("domain", glob))
        post = []
        for k in range(2):
            x = math.log(prior[k]) + likelihood[p[0]][k] + math.log(smooth("suffix", glob)[k] / glob[k])
            post.append(x + (math.log(smooth("declared", glob)[k] / glob[k]) if mark_of(p[2]) else 0.0))
        share = 1 / (1 + math.exp(min(post) - max(post)))
        for r in found[p[0]]:
            assert r.probability == pytest.approx(share, rel=1e-3) and (abs(post[0] - post[1]) < 1e-3 or r.lang == langs[post.index(max(post))])
    assert len(found[3]) == 2


# --- op6

def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r in rules:
        if re.search(r["pattern"], host + path) and (best is None or (r["priority"], r["rule"]) > (best["priority"], best["rule"])):
            best = r
    return host, path, best["rule"] if best else None, best["verdict"] if best else default


URLS = [None, "", "no address", "http://", "http://ORG/", "https://a.org", "https://a.ORG/?x", "http://Example.org/es/1", "http://m.example.org/en/123#t", "http://badexample.org/en/1", "ftp://x.com/fr/a", "https://com/de/", "https://x.com/de", "http://www.spam-farm.example.net/a", "http://a.net/spam-farm./", "http://x.com/fr/a://org/", "//x", "http://casino-win.example.com:80/de/"]


def test_urls_match_brute_force(spark):
    rules = [url_filter.host_rule(*r) for r in url_filter.HOST_RULES] + [url_filter.pattern_rule(*r) for r in url_filter.PATTERN_RULES] + [{"rule": "any-number", "pattern": r"/\d+$", "verdict": "block", "priority": 1, "tokens": []}]
    rows = list(enumerate(URLS)) + [(7, URLS[7]), (None, URLS[8])]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in rows], "page_id bigint, url string, rule string, verdict string")
    for in_row in (100, 0):
        judged = url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules), in_row=in_row)
        assert sorted(map(tuple, judged.collect()), key=str) == sorted(((i, *judge(u, rules)) for i, u in rows), key=str)
        assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, rules), in_row=in_row).count() == 0
        assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules).limit(0), in_row=in_row).collect()} == {"allow"}
        tied = [dict(rules[0], rule=n, pattern="^a", verdict=v, priority=3, tokens=[]) for n, v in (("x", "allow"), ("y", "block"))]
        assert [r.rule for r in url_filter.filter_urls(pages.filter("page_id = 5"), url_filter.rules_frame(spark, tied), in_row=in_row).collect()] == ["y"]
    plan = url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # addresses stay where they are


def test_very_long_addresses(spark):
    url = "http://x.com/fr/" + "a/b." * 50_000 + "?q"
    pages = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    found = url_filter.filter_urls(pages, url_filter.rules_frame(spark, [url_filter.host_rule(*r) for r in url_filter.HOST_RULES])).first()
    assert found.rule == "com/fr/" and len(found.path) == len(url) - 14


# --- op8

BASE = [None, "", "write a.b@c-d.example.org, or x@y", "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (682) 555-5413 +12", "é +49 30 1234567890 a@b.co", "1" * 5000 + "." + "a" * 5000 + "@" + "b" * 5000]


def base_brute(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group(0))
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m.group(0).split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(BASE)] + [(None, BASE[2], "x")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).collect()
    assert len(found) == len(rows)
    for r in found:
        text = BASE[2] if r.doc_id is None else BASE[r.doc_id]
        assert [tuple(s) for s in r.base] == base_brute(text)
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+ -(4") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == base_brute(text)
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"filler text then call me at +1 (682) 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "you may call me at 682-555-7777 today"), (51, "the count was 682-555-7777 in total"), (52, "of the 12345 units"), (53, None)]
    rows += [(60 + i, f"of the +1 (682) 555-{2000 + i} x") for i in range(5)] + [(80 + i, f"of the {10000 + i} x") for i in range(20)]
    rows += [(200 + i, "you may call me at 682-555-7777 today") for i in range(30)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = rows[12][1]
    assert [(s.kind, text[s.start : s.end]) for s in found[50].found] == [(3, "682-555-7777")]
    assert found[200].found == found[50].found
    assert not any(found[i].found for i in (51, 52, 53, 80, 85, 60, 0))


# --- op10

def test_licenses_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = "some words that stand here for a longer text " * 10
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.py", filler), (3, "a/b/c/y.py", filler + "\n" + gpl), (4, "a/b/c/z.py", filler), (5, "q/x.py", filler), (6, None, None), (7, "a/b/c/COPYING.txt", filler + "\n" + gpl), (8, "a/b/c/d/e/f.py", ""), (9, "r/short.txt", "here it is\n" + mit), (10, "r/other.txt", filler), (None, "a/u.py", filler), (11, "q/y.py", "licensed " * 5000), (12, "q/z.py", "we know the version of the work that is licensed")]
    files = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id bigint, path string, text string, license string")
    found = {r.doc_id: r for r in licenses.scan_licenses(files).collect()}
    assert len(found) == len(rows)
    got = {i: (r.license, r.how, r.from_id) for i, r in found.items()}
    assert got[1] == ("MIT", "header", 1) and got[2] == ("MIT", "inherited", 1) and got[3] == ("GPL-3.0", "header", 3)
    assert got[4] == ("GPL-3.0", "inherited", 7) and got[8] == ("GPL-3.0", "inherited", 7)
    assert got[10] == ("MIT", "inherited", 9) and got[None] == ("MIT", "inherited", 1)
    assert all(got[i] == (None, None, None) for i in (5, 6, 11, 12))
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_real_license_files_and_headers(spark):
    """Whole texts, titles, notices in comments and tags are found among prose, and unlike ones are not."""
    whole = dict(license_texts.WHOLE)
    prose = "the river runs past the old mill and turns south before it meets the road again\n" * 5
    comment = lambda text: "\n".join("# " + line for line in textwrap.wrap(text, 60))
    mit = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + whole["MIT"]
    apache = " " * 30 + "Apache License\n" + " " * 25 + "Version 2.0, January 2004\n" + " " * 20 + "http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n" + prose
    rows = [
        (1, "a/LICENSE", mit, "MIT"), (2, "z/LICENSE", apache, "Apache-2.0"), (3, "b/COPYING", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + whole["BSD-3-Clause"], "BSD-3-Clause"),
        (4, "c/LICENSE.txt", "Copyright 2021 J. D.\n\n" + dict(license_texts.WHOLE[:3])["BSD-2-Clause"], "BSD-2-Clause"), (5, "d/x.py", "The MIT License (MIT)\n" + prose, "MIT"),
        (6, "d/y.py", "# SPDX-License-Identifier: MIT\n" + prose, "MIT"), (7, "d/z.py", "// SPDX-License-Identifier: GPL-3.0-or-later\n" + prose, "GPL-3.0"), (8, "d/w.py", "#!/usr/bin/env python\n#\n" + comment(license_texts._APACHE_NOTICE) + "\n#\n\nimport os\n" + prose, "Apache-2.0"),
        (9, "e/x.py", prose, None), (10, "e/y.py", "the license of the driver and the version of the software are mentioned here only\n" + prose, None), (11, "a/b/c/d.py", prose, "MIT"), (12, "z/y/x.py", None, "Apache-2.0"),
        (13, "e/z.py", "word " * 300_000 + "\nSPDX-License-Identifier: ISC", "ISC"),
    ]
    files = spark.createDataFrame([(i, p, t) for i, p, t, _ in rows] + [(1000 + i, f"e/{i}.txt", prose + f"number {i} of the work") for i in range(300)] + [(9, "e/x.py", prose)], "doc_id bigint, path string, text string")
    found = licenses.scan_licenses(files).collect()
    assert len(found) == len(rows) + 301
    got = {r.doc_id: r for r in found}
    assert {i: got[i].license for i, *_ in rows} == {i: name for i, _, _, name in rows}
    assert (got[11].how, got[11].from_id) == ("inherited", 1) and all(got[1000 + i].license is None for i in range(300))


def test_ties_go_to_the_greater_name_and_the_smallest_file(spark):
    line = "Released under the MIT License."
    files = spark.createDataFrame([(3, "a/x", line), (2, "a/y", line), (5, "a/z", "nothing here")], "doc_id bigint, path string, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(files, [("A", line), ("B", line)]).collect()}
    assert found[3].license == found[2].license == "B" and found[5].from_id == 2


def test_deciding_words_miss_no_line():
    counts = {w: 3 for words in licenses.template_words(licenses.TEMPLATES) for w in words}
    counts |= {"the": 900, "of": 900, "under": 200, "license": 10}
    _, vectors = licenses.template_weights(licenses.TEMPLATES, counts, 1000)
    deciding = set(licenses.deciding_words(vectors, 0.8))
    for weights in vectors:
        assert sum(x * x for w, x in weights.items() if w not in deciding) ** 0.5 < 0.8


def test_short_items_in_spark_and_sql(spark, tmp_path):
    """Items of one to four words within longer texts, against the SQL of the query."""
    import duckdb

    spark.createDataFrame([(1, "the Capital of France, is it not known to all of us"), (2, "capital of"), (3, "capital of france"), (4, None), (5, "france capital of"), (6, "one two three four five six seven")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "capital of France"), (2, "seven"), (3, "two three four five six"), (4, ""), (5, "known to"), (6, "a b c d")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontaminate(spark, str(tmp_path)).collect()}
    assert found == {(1, 1), (3, 1), (6, 2), (6, 3), (1, 5)}
    views = [f"read_parquet('{tmp_path}/{n}.parquet/*.parquet')" for n in ("documents", "benchmark")]
    assert {tuple(r[:2]) for r in duckdb.sql(decontaminate.contained_sql(*views)).fetchall()} == found
