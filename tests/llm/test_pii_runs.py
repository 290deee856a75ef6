import random
from collections import defaultdict

import pytest

from ampereflow.llm import pii


def unknown(text):
    return [o[4] for o in pii.occurrences(text, pii.base_spans(text)) if o[0] is None]


def test_runs_are_cut_at_seeds():
    assert unknown("customer no 12345678 jane@x.com") == ["12345678"]
    assert unknown("phone 0171-5557713 10.0.0.1") == ["0171-5557713"]
    assert unknown("no 12345678 jane@x.com 0171-5557713 x") == ["12345678", "0171-5557713"]


def test_long_runs_give_their_words():
    words = [f"AB-{i}-0000000000000000" for i in range(10, 18)]
    assert unknown("line " + " ".join(words)) == [w.lower() for w in words]


def test_rest_of_a_word_that_holds_a_seed():
    assert unknown("see <jane@x.com>,77777 and x") == ["77777"]
    assert unknown("see <jane@x.com>; 10.0.0.1 4444-5") == ["4444-5"]


def test_candidates_never_overlap_seeds():
    text = "to 5555-1 jane@x.com 10.0.0.1 +49 30 1234567 88888 4111 1111 1111 1111 a7777"
    spans = pii.base_spans(text)
    for kind, _, s, e, *_ in pii.occurrences(text, spans):
        assert kind is not None or all(e <= a or b <= s for _, a, b in spans)


def test_what_ran_into_a_dropped_match_is_a_candidate():
    text = "x +1 (974) 555-3436 4929148385146306 y"
    assert not pii.base_spans(text)
    assert unknown(text) == ["+1 (974) 555-3436", "4929148385146306"]


def test_keys_and_line_starts():
    def patterns(text):
        return [o[5] for o in pii.occurrences(text, pii.base_spans(text))]

    assert "K token" in patterns('the token = "a1b2c3d4"')[0] and "K token" in patterns("token:a1b2c3d4")[0] and "K token" in patterns("'token': 'a1b2c3d4'")[0]
    assert not [p for p in patterns("see http://1.x.org/2")[0] if p.startswith("K")]
    assert {"L1 ^", "L2 ^ ^"} <= set(patterns("one two\n12345 more")[0])
    assert {"L1 two", "L2 one two", "R1 more", "B two _ more"} <= set(patterns("One two: (12345) more")[0])
    long = "w" * 5000
    assert max(map(len, patterns(f"{long} {'9' * 9000} {long}")[0])) < 200


def brute_scores(edges, min_seeds, rounds):
    slots = defaultdict(dict)
    for p, i, k, n in edges:
        slots[p][i] = (k, n)
    scores = {}
    kinds = {k for *_, k, _ in edges if k}
    pairs = [(p, k) for p in slots for k in kinds if sum(v[0] == k for v in slots[p].values()) >= min_seeds]
    given = {}
    for step in range(rounds + 1):
        new = {}
        for p, k in pairs:
            total = 0.0
            for i, (kind, never) in slots[p].items():
                total += 1.0 if kind == k else given.get((i, k), pii.PRIOR) if kind is None and never != k else 0.0
            new[p, k] = (total + pii.PRIOR) / (len(slots[p]) + 1)
        scores = new
        given = {}
        for i in {i for p in slots for i in slots[p]}:
            for k in kinds:
                held = [scores[p, k] for p, kk in pairs if kk == k and i in slots[p] and slots[p][i][0] is None and slots[p][i][1] != k]
                if held:
                    given[i, k] = (sum(held) + pii.PRIOR) / (len(held) + 1)
    return scores


def test_scores_match_brute_force(spark):
    rng = random.Random(3)
    kind = {f"i{i}": rng.choice([None, None, "card", "phone"]) for i in range(60)}
    never = {i: rng.choice([None, None, "card"]) if k is None else None for i, k in kind.items()}
    edges = list({(f"p{rng.randrange(12)}", i) for i in kind for _ in range(4)})
    edges = [(p, i, kind[i], never[i]) for p, i in edges]
    table = spark.createDataFrame(edges, "pattern string, instance string, kind string, not_kind string")
    found = {(r.pattern, r.kind): r.confidence for r in pii.score_patterns(table, 3, 2).collect()}
    expected = brute_scores(edges, 3, 2)
    assert found.keys() == expected.keys() and len(found) > 5
    assert all(found[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)
    assert pii.score_patterns(table.limit(0)).count() == 0


def test_hidden_seeds_are_found_again(spark):
    rng = random.Random(4)
    words = "so that they were then near some other old house and what came after it".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for i in range(60):
        texts.append(f"{prose(20)} write to user{i}.x@mail{i}.example.org {prose(9)} from host 10.{i}.0.{i + 7} {prose(5)}")
        texts.append(f"{prose(12)} call +1 (682) 555-{1000 + i} {prose(5)} in {1900 + i} about {prose(3)}")
        texts.append(f"{prose(6)} page {i + 100} of {prose(3)} {i + 2000} items")
    texts += ["", None, "write to jané@straße.example today", "mail me at " + "x" * 3000, "9" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.kind: r for r in pii.hidden_recall(docs, hide=4).collect()}
    for kind in (0, 1, 3):
        assert rows[kind].hidden >= 8 and rows[kind].recalled >= 0.9 * rows[kind].hidden
        assert rows[kind].recalled >= 0.8 * rows[kind].found
    found = {r.doc_id: r.found for r in pii.find_personal_data(docs).collect()}
    text = texts[182]
    assert [(s.kind, text[s.start : s.end]) for s in found[182]] == [(0, "jané@straße.example")]
    assert not any(found[i] for i in range(len(texts)) if i != 182)


def test_secrets_are_found_by_their_keys(spark):
    texts = [f'here token = "{i:04d}abcdef0123456789abcdef" is set' for i in range(6)] + ["a token = plain9 word", "commit = 0123456789abcdef0123456789abcdef01234567", "the tokens 12345 of"]
    found = {r.doc_id: r.found for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [(s.kind, texts[0][s.start : s.end]) for s in found[0]] == [(4, "0000abcdef0123456789abcdef")]
    assert [(s.kind, texts[6][s.start : s.end]) for s in found[6]] == [(4, "plain9")] and not found[7] and not found[8]


def test_long_texts_with_many_candidates_take_linear_time():
    import time

    def seconds(count):
        text = "word 12345x, other " * count
        spans = pii.base_spans(text)
        best = []
        for _ in range(2):
            began = time.time()
            found = pii.occurrences(text, spans)
            best.append(time.time() - began)
        assert len(found) == count
        return min(best)

    assert seconds(40_000) < 3 * 4 * max(seconds(10_000), 0.05)


def test_secrets_have_a_column_of_their_own(spark):
    found = pii.op8_pii(spark, "/root/testdata/sf0.01").select("spans", "secrets").collect()
    kinds = {s.split(":")[0] for r in found for s in r.spans.split(",") if s}
    assert kinds <= set(pii.KINDS)
    assert {s.split(":")[0] for r in found for s in r.secrets.split(",") if s} == {"secret"}
