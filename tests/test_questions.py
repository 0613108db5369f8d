"""Very many questions against plain versions."""

import math
import random

import duckdb
import pyarrow as pa
import pytest

from lodestone.operators import feedback, inverted, questions
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.questions import ManyQuestions
from lodestone.plans import queries


def corpus(draw, n):
    """Texts of some very common, some common and many rare words; two in ten
    are copies, so that scores tie."""
    word = lambda: draw.choice([f"the{draw.randint(0, 2)}", f"c{draw.randint(0, 9)}", f"r{int(draw.paretovariate(0.6)) % 400}"])
    texts = []
    for _ in range(n):
        texts.append(draw.choice(texts) if texts and draw.random() < 0.2 else " ".join(word() for _ in range(draw.randint(0, 30))))
    return texts


@pytest.mark.parametrize("group", [7, 50, 1 << 15])
def test_many_questions_equal_the_pruned_ranking(spark, monkeypatch, group):
    monkeypatch.setattr(questions, "GROUP", group)
    monkeypatch.setattr(questions, "LEAST", 9)
    draw = random.Random(3)
    docs = list(enumerate(corpus(draw, 300))) + [(5, "r1 r2 the0"), (5, "r1 r1 r2"), (None, "r1 r2 r3"), (900, None)]
    draw.shuffle(docs)
    index = InvertedIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), span=6, buckets=4)
    asked = [(i, t) for i, t in enumerate(corpus(draw, 60))] + [(100, "the0 the1 the2"), (101, "nobody"), (102, ""), (103, None), (None, "c1 c2"), (0, "r7")]
    asked = spark.createDataFrame(asked, "qid long, input string")
    assert group > 50 or ManyQuestions(index).groups > 5
    held = {}
    for i, t in docs:
        held.setdefault(i, []).append(set((t or "").split()))
    for words in (None, asked.selectExpr("explode(split(input, ' ')) AS term")):
        ready = ManyQuestions(index, words)
        for k in (1, 3, 10):
            got = sorted((-1 if r.qid is None else r.qid, r.rk, r.doc_id, r.score) for r in ready.best(asked, k).collect())
            some = asked.filter("qid is not null")
            want = sorted((r.qid, r.rk, r.doc_id, r.score) for r in inverted.bm25_pruned(index, some, k).collect())
            assert [r[:3] for r in got if r[0] >= 0] == [r[:3] for r in want] and all(math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip((r for r in got if r[0] >= 0), want))
            assert sum(r[0] < 0 for r in got) == k
        words_of = {r.qid: set(r.words) for r in asked.selectExpr("qid", "split(input, ' ') AS words").filter("qid between 1 and 99").collect()}
        for r in ready.best(asked, 3).filter("qid between 1 and 99").collect():
            assert r.met in {len(words_of[r.qid] & h) for h in held[r.doc_id]}
    assert ready.best(asked.limit(0)).count() == 0
    empty = InvertedIndex.build(spark.createDataFrame([], "doc_id long, text string"))
    assert ManyQuestions(empty).best(asked).count() == 0


def test_questions_do_not_travel_with_the_blocks(spark):
    docs = spark.createDataFrame([(i, f"the and w{i}") for i in range(50)], "doc_id long, text string")
    ready = ManyQuestions(InvertedIndex.build(docs, span=8))
    assert ready.packs.count() == ready.groups == 1
    asked = spark.createDataFrame([(i, f"the and w{i % 50}") for i in range(1500)], "qid long, input string")
    assert all(r.doc_id == r.qid % 50 and r.met == 3 for r in ready.best(asked).collect())


def test_the_loop_takes_repeated_rows_and_documents_one_by_one(spark):
    docs = [(1, "red fox hill"), (1, "red fox hill"), (2, "blue whale sea"), (3, "the hill")]
    index = InvertedIndex.build(spark.createDataFrame(docs, "doc_id long, text string"))
    texts = ["red blue whale fox of another town somewhere", "red fox"]
    alone = {t: next(tuple(r)[1:] for r in feedback.corrected(index, None, spark.createDataFrame([(7, t)], "qid long, input string")).collect()) for t in texts}
    asked = spark.createDataFrame([(7, texts[0]), (7, texts[0]), (7, texts[1]), (None, texts[1])], "qid long, input string")
    got = sorted((tuple(r) for r in feedback.corrected(index, None, asked).collect()), key=str)
    assert got == sorted([(7, *alone[texts[0]]), (7, *alone[texts[0]]), (7, *alone[texts[1]]), (None, *alone[texts[1]])], key=str)
    assert alone[texts[0]][1] > 1


def graph_rows(spark, folder, docs, turns):
    """The rows of graph_run, and those of its SQL."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT conv_id, turn, node, best_doc FROM ({queries.oracle_sql()['graph_run']})").fetchall()
    return sorted(map(tuple, queries.graph_run(spark, str(folder)).collect()), key=str), sorted(want, key=str)


def turns_of(draw, n):
    return [(i // 4, i % 4, draw.choice(["user", "user", "system", "assistant"]), t if draw.random() < 0.9 else t * 30) for i, t in enumerate(corpus(draw, n))]


@pytest.mark.parametrize("again", [[], [(3, "r1 r2 the0"), (3, "r1 r5 the1"), (4, "c1 c1 the0 r9 r9 r9"), (None, "r1 r2 r3"), (None, "r1 r1 r2")]])
def test_the_graph_equals_its_sql_with_repeated_and_missing_ids(spark, tmp_path, again):
    draw = random.Random(8)
    docs = [(i, t) for i, t in enumerate(corpus(draw, 200))] + 2 * again
    turns = [*turns_of(draw, 80), (90, 0, "user", "r1 r2 r3"), (90, 1, "user", "the0 the1"), (90, 2, "user", "nobody"), (91, 0, "user", ""), (91, 1, "user", "r9 c1")]
    got, want = graph_rows(spark, tmp_path, docs, turns)
    assert got == want and len({r[3] for r in got}) > 5


def test_only_the_best_of_each_question_leaves_a_task(spark):
    """All questions share a word with all documents."""
    docs = spark.createDataFrame([(i, f"the w{i} v{i % 7}") for i in range(400)], "doc_id long, text string")
    ready = ManyQuestions(InvertedIndex.build(docs, positions=False))
    code = {r.term: r.code for r in ready.words.collect()}
    asked = pa.table({"question": list(range(300)), "codes": [sorted([code["the"], code[f"w{i}"]]) for i in range(300)]})
    found = questions._score(ready.packs.toArrow(), asked, 1, ready.k1, ready.b, ready.mean)
    assert found["question"].to_pylist() == found["doc_id"].to_pylist() == list(range(300)) and set(found["met"].to_pylist()) == {2}
