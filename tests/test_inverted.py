"""The stored inverted index against plain versions, and what its plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.ranking import bm25
from lodestone.operators.terms import Index

TEXTS = "doc_id long, text string, term string, range int"


def tok(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(words, weights=[1 / (r + 1) for r in range(40)], k=draw.randint(0, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "w1 " * 5000 + "w39 w38")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], TEXTS).repartition(3)
    return rows, df


@pytest.fixture(scope="module")
def index(corpus):
    return InvertedIndex.build(corpus[1], span=32, buckets=8)


def asked(spark, inputs):
    return spark.createDataFrame(list(enumerate(inputs)), "qid long, input string")


def test_an_index_opened_by_path_holds_the_corpus(spark, corpus, index):
    again = InvertedIndex(spark, index.path)
    assert again.n == len(corpus[0]) and abs(again.mean - sum(len(tok(t)) for _, t in corpus[0]) / len(corpus[0])) < 1e-9
    want = {}
    for _, t in corpus[0]:
        for w in set(tok(t)):
            want[w] = want.get(w, 0) + 1
    assert {r.term: r.df for r in again.terms().collect()} == want


def test_postings_come_back_as_they_were(spark, corpus, index):
    heads = {r.range: r.ids for r in index.headers().collect()}
    got = {}
    for r in index.blocks.filter("term is not null").collect():
        block = inverted.Block({c: inverted.numbers(inverted.np.frombuffer(r[c], inverted.np.uint8)) for c in ("at", "tfs", "positions")})
        for key in block.keys().tolist():
            got.setdefault((heads[r.range][key >> 32], r.term), []).append(key & 0xFFFFFFFF)
    want = {}
    for i, t in corpus[0]:
        for p, w in enumerate(tok(t)):
            want.setdefault((i, w), []).append(p)
    assert got == want


def test_packed_numbers():
    values = inverted.np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 5])
    assert inverted.numbers(inverted.varints(values)[0]).tolist() == values.tolist() and inverted.varints(values)[1][:5].tolist() == [1, 1, 1, 2, 2]


@pytest.mark.parametrize("shelf", [1, 64])
def test_pruned_ranking_equals_bm25_over_the_forward_index(spark, corpus, index, shelf, monkeypatch):
    monkeypatch.setattr(inverted, "SHELF", shelf)
    queries = asked(spark, ["w1 w20 w39", "w0", "w0 w1 w2 w3", "nothing here", "", None, "w39 w38 w38"])
    plain = sorted(map(tuple, bm25(Index(corpus[1]), queries).collect()))
    assert sorted(map(tuple, inverted.bm25_pruned(index, queries).collect())) == plain
    assert sorted(map(tuple, inverted.bm25_pruned(index, queries, prune=False).collect())) == plain
    told = {r.qid: (r.postings, r.scored) for r in inverted.bm25_pruned(index, queries, k=3, report=True).collect()}
    assert set(told) == {0, 1, 2, 6} and all(0 < s <= p for p, s in told.values())
    assert shelf == 1 or told[6][1] < told[6][0]
    seeded = lambda **x: inverted.bm25_pruned(index, queries, seeds=2, **x)
    assert sorted(map(tuple, seeded().collect())) == plain
    less = {r.qid: r.scored for r in seeded(k=3, report=True).collect()}
    assert less[6] < told[6][1] if shelf == 1 else less[6] <= told[6][1]


def test_more_queries_than_travel_with_a_block(spark, corpus, index, monkeypatch):
    monkeypatch.setattr(inverted, "ASKED", 2)
    monkeypatch.setattr(inverted, "SMALL", 3)
    queries = asked(spark, [f"w{i} w{i + 1}" for i in range(9)])
    assert sorted(map(tuple, inverted.bm25_pruned(index, queries).collect())) == sorted(map(tuple, bm25(Index(corpus[1]), queries).collect()))


def test_phrases(spark, corpus, index):
    inputs = ["w0 w1", "w1 w1", "w1 w1 w1", "w2", "w3 w0 w1", "w39 w38", "w0 nothing", ""]
    want = []
    for q, phrase in enumerate(map(tok, inputs)):
        for i, t in corpus[0]:
            w = tok(t)
            at = [p for p in range(len(w) - len(phrase) + 1) if phrase and w[p : p + len(phrase)] == phrase]
            want += [(q, i, len(at), at[0])] if at else []
    assert sorted(map(tuple, inverted.phrases(index, asked(spark, inputs)).collect())) == sorted(want)


def test_proximity(spark, corpus, index):
    inputs, window = ["w5 w9", "w0 w7 w12", "w1 w39 w38", "w4", "w6 w6", "w0 nothing"], 6
    want = []
    for q, terms in enumerate(map(set, map(tok, inputs))):
        for i, t in corpus[0]:
            w, best = tok(t), None
            for p in range(len(w)):
                seen = set()
                for e in range(p, min(p + window, len(w))):
                    seen.add(w[e]) if w[e] in terms else None
                    if seen == terms and w[p] in terms:
                        best = min(best or (99, 0), (e - p + 1, p))
                        break
            want += [(q, i, *best)] if best else []
    assert sorted(map(tuple, inverted.proximity(index, asked(spark, inputs), window).collect())) == sorted(want)


def test_a_query_reads_the_folders_of_its_terms(spark, index):
    one = index.of_terms(spark.createDataFrame([("w3",)], "term string"))
    here = spark.range(1).select(inverted.bucket_of(F.lit("w3"), index.buckets)).first()[0]
    assert {re.search(r"bucket=(-?\d+)", f).group(1) for f in one.inputFiles()} >= {str(here)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {here}|IN \({here}\))", plan)


def test_ranges_are_cut_by_tokens_too(spark, corpus, index, monkeypatch):
    monkeypatch.setattr(inverted, "TOKENS", 100)
    small = InvertedIndex.build(corpus[1])
    assert all(sum(r.lengths) <= 100 or len(r.lengths) == 1 for r in small.headers().collect())
    queries = asked(spark, ["w1 w2", "w39 w38"])
    for search in (inverted.phrases, inverted.bm25_pruned):
        assert sorted(map(tuple, search(small, queries).collect())) == sorted(map(tuple, search(index, queries).collect()))


def test_odd_tables(spark, corpus):
    none = InvertedIndex.build(corpus[1].limit(0))
    assert none.n == 0 and none.terms().count() == 0 and inverted.bm25_pruned(none, asked(spark, ["w1"])).count() == 0
    assert inverted.phrases(none, asked(spark, ["w1 w2"])).count() == 0
    rows = [(None, "a b"), (7, "a b c"), (7, "a x b"), (7, "a b c")]
    some = InvertedIndex.build(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], TEXTS).coalesce(1))
    assert some.n == 4 and [(r.doc_id, r.rk) for r in inverted.bm25_pruned(some, asked(spark, ["a b"])).collect()] == [(7, 1)]
    assert sorted(map(tuple, inverted.phrases(some, asked(spark, ["a b"])).collect())) == [(0, 7, 1, 0), (0, 7, 1, 0)]
