"""The index that a stream keeps up to date, whatever the batches."""

import hashlib
import random
import re

import pytest

from lodestone.operators.ranking import bm25
from lodestone.operators.terms import Index
from lodestone.sources.shared import shared_path
from lodestone.streaming.incremental import LOWEST, SegmentedIndex

CHANGES = "doc_id long, text string, version long, deleted boolean, terms string, segment int"


def tok(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def some_changes(seed, n=160):
    draw = random.Random(seed)
    text = lambda: " ".join(draw.choices([f"w{i}" for i in range(12)], k=draw.randint(0, 8)))
    rows = [(draw.choice([1, 1, 1, *range(2, 30)]), text(), draw.randrange(6), draw.random() < 0.2, "x", 1) for _ in range(n)]
    rows += rows[:10]  # the same rows again
    return rows + [(None, "w1", 9, False, "x", 1), (40, None, None, None, "x", 1), (41, "", 0, None, "x", 1), (42, "w1 w1 W2", None, False, "x", 1), (43, None, 2, True, "x", 1), (44, "w3 " * 20000, 1, False, "x", 1)]


def plain(rows):
    best = {}
    for i, text, version, deleted, *_ in rows:
        if i is not None:
            order = (LOWEST if version is None else version, bool(deleted), hashlib.md5((text or "").encode()).hexdigest())
            best[i] = max(best.get(i, ((),)), (order, text), key=lambda b: b[0])
    return {i: tok(text) for i, (order, text) in best.items() if not order[1]}


def held(index):
    return {r.doc_id: (r.dl, {t.term: t.tf for t in r.terms}) for r in index.open().docs.collect()}


def counted(docs):
    return {i: (len(ws), {w: ws.count(w) for w in set(ws)}) for i, ws in docs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_index_of_the_whole(spark, seed):
    rows = some_changes(seed)
    draw = random.Random(seed)
    draw.shuffle(rows)
    index, k = SegmentedIndex(spark), 0
    assert held(index) == {}
    while k < len(rows):
        n = draw.randint(1, 70)
        index.add(spark.createDataFrame(rows[k : k + n], CHANGES))
        k += n
        if draw.random() < 0.4:
            index.compact()
    index.add(spark.createDataFrame(rows[:50], CHANGES))  # a batch again, too late
    index.add(spark.createDataFrame([], CHANGES))
    want = counted(plain(rows))
    assert held(index) == want
    index.compact()
    assert len(index.segments()) == 1 and held(SegmentedIndex(spark, index.path)) == want
    opened = index.open()
    assert opened.n == len(want)
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in plain(rows).items()], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w3"), (2, "w7")], "qid long, input string")
    ranked = lambda i: sorted(map(tuple, bm25(i, asked).collect()))
    assert ranked(opened) == ranked(Index(docs))


def test_a_stream_with_a_restart_and_a_compaction_between(spark):
    rows = some_changes(3)
    source, checkpoint = shared_path(spark, "changes"), shared_path(spark, "stream")
    index = SegmentedIndex(spark)
    for half in (rows[:90], rows[90:]):
        spark.createDataFrame(half, CHANGES).repartition(4).write.mode("append").parquet(source)
        changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        query = SegmentedIndex(spark, index.path).follow(changes, checkpoint, availableNow=True)
        query.awaitTermination()
        before = len(index.segments())
        index.compact()
        assert before >= 4 and len(index.segments()) == 1
    assert held(index) == counted(plain(rows))


def test_a_batch_that_died_leaves_nothing_and_one_that_runs_again_adds_nothing(spark, monkeypatch):
    rows = [(1, "a b", 1, False, "x", 1), (2, "c", 1, False, "x", 1)]
    source, checkpoint = shared_path(spark, "changes"), shared_path(spark, "stream")
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(source)
    changes = spark.readStream.schema(CHANGES).parquet(source)
    index = SegmentedIndex(spark)
    add = index.add

    def dies(batch):
        add(batch)
        raise RuntimeError("lost after its files and its row of the log")

    monkeypatch.setattr(index, "add", dies)
    with pytest.raises(Exception, match="lost after"):
        index.follow(changes, checkpoint, availableNow=True).awaitTermination()
    monkeypatch.setattr(index, "add", add)
    index.follow(changes, checkpoint, availableNow=True).awaitTermination()
    assert len(index.segments()) == 2 and held(index) == counted(plain(rows))
    index._rows(index.segments()).drop("segment").write.parquet(f"{index.path}/rows/segment=orphan")  # died before its row
    assert len(index.segments()) == 2 and held(index) == counted(plain(rows))


def test_forgotten_tombstones_make_older_rows_too_late(spark):
    index = SegmentedIndex(spark)
    add = lambda *rows: index.add(spark.createDataFrame([(*r, "x", 1) for r in rows], CHANGES))
    add((1, "a", 1, False), (2, "b", 1, False))
    add((1, None, 5, True), (2, None, 9, True))
    index.compact(forget=6)
    assert index._rows(index.segments()).count() == 1  # the tombstone of version 9
    add((1, "old", 4, False), (2, "old", 8, False), (3, "late", 5, False), (4, "new", 6, False))
    assert held(index) == {4: (1, {"new": 1})}
    index.compact()
    assert held(index) == {4: (1, {"new": 1})}
