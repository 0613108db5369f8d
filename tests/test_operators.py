"""Operators, sources and the stage graph against plain versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, ranking, terms
from lodestone.operators.terms import Index
from lodestone.plans.graph import END, StageGraph
from lodestone.settings import Settings
from lodestone.sources import tables


def test_index_counts_terms(spark):
    rows = [(1, "b a B a-a"), (2, ""), (3, None), (1, "b a B a-a"), (4, "x" * 50_000 + " y " * 3000)]
    index = Index(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, tf int"))
    got = sorted((r.doc_id, r.term[:3], r.tf, r.dl) for r in index.postings().collect())
    assert got == sorted([(1, "a", 3, 5), (1, "b", 2, 5)] * 2 + [(4, "xxx", 1, 3001), (4, "y", 3000, 3001)])
    assert index.n == 5 and index.mean == (5 + 5 + 3001) / 5
    assert {r.term[:3]: r.df for r in terms.term_stats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {"a": 2, "b": 2, "xxx": 1, "y": 1}
    assert Index(spark.createDataFrame([], "doc_id long, text string")).postings().count() == 0


def test_the_corpus_is_tokenized_once_and_its_text_not_shuffled(spark, sf):
    from lodestone.plans import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)  # as many partitions as a large table
    plan = ranking.bm25(Index(docs), spark.createDataFrame([(1, "some words")], "qid long, input string"))._jdf.queryExecution().toString()
    assert "split(lower(text" not in plan and "documents.parquet" not in plan
    assert terms.spread(docs) is docs
    plan = queries.rrf_fusion(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("input")[0] or "documents.parquet" not in plan


def brute_mmr(hits, sets, k, trade):
    top, left, out = max(s for _, s in hits), sorted(hits), []
    while left and len(out) < k:
        value = lambda h: round(trade * h[1] / top - (1 - trade) * max((len(sets[h[0]] & sets[o]) / len(sets[h[0]] | sets[o]) for o in out), default=0.0), 6)
        best = max(left, key=lambda h: (value(h), -h[0]))
        out.append(best[0])
        left.remove(best)
    return out


def test_mmr_equals_brute_force(spark):
    draw = random.Random(5)
    docs = {d: {f"w{draw.randint(0, 12)}" for _ in range(6)} for d in range(30)}
    hits = [(q, d, round(draw.uniform(1, 9), 3)) for q in range(8) for d in draw.sample(range(30), 10)]
    index = Index(spark.createDataFrame([(d, " ".join(s)) for d, s in docs.items()], "doc_id long, text string"))
    got = ranking.mmr(spark.createDataFrame(hits, "qid long, doc_id long, score double"), index, 5, 0.6).orderBy("qid", "rk").collect()
    for q, rows in itertools.groupby(got, lambda r: r.qid):
        assert [r.doc_id for r in rows] == brute_mmr([(d, s) for p, d, s in hits if p == q], docs, 5, 0.6)


def test_dense_knn_equals_brute_force_and_leaves_out_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.standard_normal(6).tolist()) for i in range(90)] + [(100 + i, draw.standard_normal(3).tolist()) for i in range(5)]
    odd = [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (50, [1.0] * 6), (None, [1.0] * 6), (206, [1e200] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 10 = 0")
    got = ranking.dense_knn(df, asked, k=4, block=16, asked_at_once=32).collect()
    unit = [(i, np.array(v) / max(map(abs, v))) for i, v in [*rows, (50, [1.0] * 6), (206, [1.0] * 6)]]
    for q, vs in itertools.groupby(sorted((x for x in unit if x[0] % 10 == 0 and x[0] != 50), key=lambda x: x[0]), lambda x: x[0]):
        v = next(vs)[1]
        found = sorted((-round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 6), i) for i, w in unit if i != q and len(w) == len(v))[:4]
        assert [(r.vec_id, r.rk) for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rk)] == [(i, n) for n, (_, i) in enumerate(found, 1)]
    assert {r.qid for r in got} == {q for q, _ in rows if q % 10 == 0}
    assert ranking.dense_knn(df.limit(0), asked).count() == 0 and ranking.dense_knn(df, asked.limit(0)).count() == 0


def test_grades_of_repeated_labels(spark):
    hits = spark.createDataFrame([(1, d) for d in range(4)], "qid long, doc_id long")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in answers.grade_filter(hits, labels).collect()) == [0, 3]


def test_html(spark):
    page = "<!doctype html><HTML><Head lang=en>\n<TITLE>A &amp; B</TITLE><style>x</style></HEAD><header>Top</header><Script>if (a<b)</SCRIPT >one &lt;two&gt;&nbsp;<!-- no --> caf&eacute; &amp;lt; <script>open"
    got = {r.page_id: (r.title, r.body) for r in answers.html_to_text(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()}
    assert got == {1: ("A & B", "Top one <two> caf&eacute; &lt;"), 2: ("", ""), 3: ("", "")}


def test_generate_calls_the_given_generator(spark):
    prompts = spark.createDataFrame([(1, "ab"), (2, "c")], "qid long, prompt string")
    assert {r.qid: r.answer for r in answers.generate(prompts, lambda p: p[::-1] + "!").collect()} == {1: "ba!", 2: "c!"}


def test_qrels_of_short_items(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "so red green blues go"), (3, ""), (4, None), (1, "red green blue")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "green"), (8, "red green blue"), (9, "..."), (10, "d green b")], "item_id long, text string")
    assert sorted(map(tuple, answers.qrels(docs, items).collect())) == [(7, 1), (7, 2), (8, 1), (8, 2), (10, 1), (10, 2)]
    assert answers.qrels(docs, items.limit(0)).count() == 0


def test_evaluation_at_k(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "qid long, doc_id long, rk long")
    truth = spark.createDataFrame([(1, 6), (1, 7), (2, 8)], "qid long, doc_id long")
    assert tuple(answers.retrieval_eval(hits, truth, 2).first()) == (2, 0.5, 0.25, 0.25)
    assert tuple(answers.retrieval_eval(hits, truth, 1).first()) == (2, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_documents_come_back(spark, tmp_path, format):
    rows = [(1, 'a "b", c', "en", "s", 8), (2, None, None, "t", 0)]
    df = spark.createDataFrame(rows, tables.SCHEMAS["documents"])
    tables.write_table(df, f"{tmp_path}/{format}", format)
    options = {"escape": "\\"} if format == "csv" else {}
    assert sorted(map(tuple, tables.read_documents(spark, f"{tmp_path}/{format}", format, **options).collect())) == rows
    tables.write_table(df, f"{tmp_path}/by", format, partition_by=["source"])
    assert tables.read_documents(spark, f"{tmp_path}/by", format, **options).filter("source = 't'").count() == 1


def test_text_files_are_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    got = {r.source.rpartition("/")[2]: (r.text, r.n_chars) for r in tables.read_documents(spark, str(tmp_path), "text").collect()}
    assert got["a.txt"] == ("one\ntwo", 7) and len({r.doc_id for r in tables.read_documents(spark, str(tmp_path), "text").collect()}) == len(got)


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"k": 3}))
    assert Settings.load(tmp_path / "s.json") == Settings(k=3)
    (tmp_path / "s.json").write_text(json.dumps({"kk": 3}))
    with pytest.raises(ValueError, match="kk"):
        Settings.load(tmp_path / "s.json")


def halving():
    return StageGraph().add_node("halve", lambda s: s.withColumn("n", (F.col("n") / 2).cast("int")).withColumn("steps", F.col("steps") + 1)).add_condition("halve", F.when(F.col("n") > 0, "halve"), {"halve"})


def test_a_loop_runs_until_each_row_has_ended(spark):
    state = spark.createDataFrame([(i, i, 0) for i in (1, 2, 3, 9, 9)], "id long, n int, steps int")
    got = halving().compile()(state, max_steps=10).collect()
    assert sorted((r.id, r.steps) for r in got) == [(i, int(math.log2(i)) + 1) for i in (1, 2, 3, 9, 9)]
    with pytest.raises(RuntimeError, match="halve"):
        halving().compile()(state, max_steps=3)
    assert halving().compile()(state.limit(0)).count() == 0


def test_rows_leave_by_several_targets(spark):
    graph = StageGraph().add_node("a", lambda s: s.withColumn("way", F.lit("a"))).add_node("b", lambda s: s.withColumn("way", F.lit("ab"))).add_node("c", lambda s: s.withColumn("way", F.lit("ac")))
    graph.add_condition("a", F.when(F.col("n") == 1, "b").when(F.col("n") == 2, "c").when(F.col("n") == 3, "nowhere"), {"b", "c"}).add_edge("b", END)
    got = graph.compile()(spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "n int")).collect()
    assert sorted((r.n, r.way) for r in got) == [(1, "ab"), (2, "ac"), (2, "ac"), (3, "a"), (4, "a")]


def test_wrong_graphs_are_told():
    stage = lambda s: s
    with pytest.raises(ValueError, match="there already"):
        StageGraph().add_node("a", stage).add_node("a", stage)
    with pytest.raises(ValueError, match="there already"):
        StageGraph().add_node(END, stage)
    with pytest.raises(ValueError, match="has an edge"):
        StageGraph().add_node("a", stage).add_edge("a", END).add_edge("a", END)
    with pytest.raises(ValueError, match="nowhere"):
        StageGraph().add_node("a", stage).add_edge("a", "b").compile()
    with pytest.raises(ValueError, match="entry"):
        StageGraph().compile()
    with pytest.raises(ValueError, match="entry"):
        StageGraph().add_node("a", stage).set_entry("z").compile()


def test_settings_reach_the_queries(spark, sf):
    from lodestone.plans import queries
    from lodestone.settings import Settings

    try:
        queries.configure(Settings(k=2))
        assert queries.queries()["bm25_topk"](spark, sf).agg({"rk": "max"}).first()[0] == 2
    finally:
        queries.configure(Settings())
