"""Feedback, the corrective loop, near spellings and spans against plain versions."""

import math
import re

from lodestone.operators import feedback
from lodestone.operators.inverted import InvertedIndex
from lodestone.plans import queries
from lodestone.plans.graph import END

DOCS = [
    (1, "red fox runs over the hill"), (2, "the red fox sleeps"), (3, "blue whale swims in the sea and the sea is blue"), (4, "a whale and a fox"),
    (5, "the hill is green and the grass is green"), (6, None), (7, "quantum fields"),
]


def tok(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def docs_of(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, score string")


def plain_best(words):
    """The best document by BM25, ties to the smaller id; None without a hit."""
    texts = {i: tok(t) for i, t in DOCS}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    scores = {}
    for w in set(words):
        df = sum(w in t for t in texts.values())
        for i, t in texts.items():
            if w in t:
                tf = t.count(w)
                scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return min(scores, key=lambda i: (-round(scores[i], 6), i)) if scores else None


def plain_loop(text, enough, most):
    df = {w: sum(w in tok(t) for _, t in DOCS) for _, t in DOCS for w in tok(t)}
    asked, steps = list(dict.fromkeys(tok(text))), 0
    while True:
        steps += 1
        best = plain_best(asked)
        if best is None:
            return " ".join(asked), steps, None, None, "unknown"
        held = set(tok(dict(DOCS)[best]))
        grade = round(len(set(asked) & held) / len(set(asked)), 6)
        if grade >= enough or steps >= most or len(asked) <= 1:
            return " ".join(asked), steps, best, grade, "answered" if grade >= enough else "given up"
        known = sorted((w for w in set(asked) if w in df), key=lambda w: (df[w], w))
        asked = sorted(known[: math.ceil(len(known) / 2)])


INPUTS = ["red fox", "the red whale of quantum physics in a lost town", "nobody knows", "", None, "sea grass hill fox sleeps quantum", "Fox fox FOX!", "green blue fields whale runs lost words everywhere"]


def test_the_loop_equals_a_plain_one_and_ends_for_all(spark):
    index = InvertedIndex.build(docs_of(spark), span=3, buckets=4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in enumerate(INPUTS)], "qid long, input string, steps string")
    for enough, most in ((0.6, 3), (1.0, 4), (0.9, 1)):
        got = {r.qid: (r.asked, r.steps, r.best_doc, r.grade, r.outcome) for r in feedback.corrected(index, docs_of(spark), asked, enough, most).collect()}
        assert got == {i: plain_loop(t, enough, most) for i, t in enumerate(INPUTS)}
    assert feedback.corrected(index, docs_of(spark), asked.limit(0)).count() == 0


def test_the_loop_is_a_cyclic_graph(spark):
    graph = feedback.corrective_graph(InvertedIndex.build(docs_of(spark)), docs_of(spark))
    assert graph._loops() and END in graph._targets["grade"]


def test_every_user_turn_ends(spark, sf):
    got = queries.queries()["corrective_loop"](spark, sf).collect()
    asked = queries._asked_turns(spark, sf)
    assert sorted(r.qid for r in got) == sorted(r.qid for r in asked.collect())
    assert {r.outcome for r in got} <= {"answered", "given up", "unknown"} and all(1 <= r.steps <= 3 for r in got)
    assert any(r.steps > 1 for r in got)


def test_relevance_model_by_hand(spark):
    hits = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 1.0, 2)], "qid long, doc_id long, score double, rk long")
    asked = spark.createDataFrame([(1, "fox fox red")], "qid long, input string")
    got = {r.term: r.weight for r in feedback.relevance_model(hits, docs_of(spark), asked, words=2).collect()}
    p = {"red": 0.75 / 6 + 0.25 / 4, "fox": 0.75 / 6 + 0.25 / 4, "the": 0.75 / 6 + 0.25 / 4}
    assert set(got) == {"fox", "red"} and math.isclose(sum(got.values()), 1)  # ties by spelling leave "the" out
    assert math.isclose(got["fox"], 0.5 * 2 / 3 + 0.5 * p["fox"] / (p["fox"] + p["red"]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_spellings_equal_brute_force(spark):
    vocabulary = {"house": 5, "mouse": 9, "horse": 5, "a": 3, "ab": 1, "niño": 2, "nino": 2, "straße": 1, "houses": 1, "": 4}
    words = ["hous", "hose", "b", "ñino", "strase", "house", "abc", None, "", "xyzzy", "hous", "mose"]
    df = spark.createDataFrame(list(vocabulary.items()), "term string, df long")
    for within, k in ((1, 3), (2, 2), (2, 99)):
        want = []
        for w in {w for w in words if w and w not in vocabulary}:
            near = sorted((distance(w, t), -n, t) for t, n in vocabulary.items() if distance(w, t) <= within)
            want += [(w, t, d, -n) for d, n, t in near[:k]]
        got = feedback.near_spellings(df, spark.createDataFrame([(w, 1) for w in words], "word string, df int"), within, k)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_spellings_of_the_tables(spark, sf):
    vocabulary = {w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in re.split(r"[^\w]+|_", r.text.lower()) if w}
    got = queries.queries()["near_spellings"](spark, sf).collect()
    assert all(r.term in vocabulary and r.word not in vocabulary and distance(r.word, r.term) == r.distance == 1 for r in got)


def test_spans_hold_each_token_once(spark):
    words = [f"t{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "t0 t1 t2")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 1, 0, 2.0), (1, 1, 1, 3.0), (1, 1, 3, 1.0), (1, 2, 0, 5.0), (2, 1, 5, 1.0)], "qid long, doc_id long, chunk_ix long, score double")
    got = sorted(map(tuple, feedback.merged_spans(hits, docs).collect()))
    want = [(1, 1, 0, 112, 3.0, 2, " ".join(words[:112])), (1, 1, 144, 208, 1.0, 1, " ".join(words[144:208])), (1, 2, 0, 3, 5.0, 1, "t0 t1 t2"), (2, 1, 240, 300, 1.0, 1, " ".join(words[240:300]))]
    assert got == want
