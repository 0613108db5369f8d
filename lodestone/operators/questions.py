"""The best documents of very many questions: exact BM25 where questions and
documents are both too many for a row of each pair that shares a term.

An index's blocks of the questions' words are packed once, a row for each group
of neighbouring ranges, and the questions are dealt into shares. A group and a
share meet in one task, which keeps sums for one question at a time, and only the
k best of each question leave it. Work is passed over where it cannot change
them: the words that few documents of the group hold are added up first; their
best documents, scored in full, give a floor; of the others only those that
reach it with the most that the common words can add are scored further (the
order of MaxScore, Turtle and Flood 1995).

Defined cases: those of the inverted index. Of rows with one id each is a
document, and the best one counts; questions without a known word have no hits.
In over_documents rows of one id are one document, as in BM25 over the forward
index, and null is an id, which comes last among equal scores.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.inverted import HEADER, InvertedIndex, _sums, leading, numbers
from lodestone.operators.ranking import query_terms
from lodestone.operators.terms import tokenize_docs
from lodestone.sources.shared import written

#: Documents and, but for a longer range, tokens of a group.
GROUP, TOKENS = 1 << 14, 12_000_000
#: A word is common if more than one in so many of a group's documents holds it.
COMMON = 4
#: Questions of a share at most; a share has LEAST if there are so many.
SHARE, LEAST = 1 << 18, 512
#: Words up to which they are sent to all tasks.
SMALL = 100_000
#: Postings that are unpacked at once.
STRETCH = 1 << 18
#: Rounding to six digits may lift a score by half a unit of the last one.
SLACK = 2e-6
NUMBERS = {"ids": np.int64, "lengths": np.int32, "codes": np.int64, "idfs": np.float64, "rows": np.int32, "first": np.int32, "n": np.int32, "at_bytes": np.int32, "tf_bytes": np.int32}
PACKED = ", ".join(["g int", *(f"{c} binary" for c in (*NUMBERS, "at", "tfs"))])
NONE = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
FOUND = pa.schema([("question", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("met", pa.int64())])


def _bytes(values: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """The bytes of binary values one after another, and how many each has."""
    whole = pa.concat_arrays(values.chunks) if values.num_chunks != 1 else values.chunk(0)
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return whole.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), np.diff(ends)


def _trimmed() -> None:
    """Gives back to the system what earlier work of this process has freed; it
    would count beside a group."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' libraries may lack it
        ctypes.CDLL(None).malloc_trim(0)


def _pack(key, blocks: pa.Table, heads: pa.Table) -> pa.Table:
    """One row of a group's blocks, by word and range."""
    schema = pa.schema([("g", pa.int32()), *((c.split()[0], pa.binary()) for c in PACKED.split(", ")[1:])])
    if not blocks.num_rows:
        return schema.empty_table()
    _trimmed()
    heads = heads.sort_by("range_")
    lengths = heads["lengths"].combine_chunks()
    sizes = lengths.value_lengths().to_numpy()
    order = np.lexsort((blocks["range"].to_numpy(), blocks["code"].to_numpy()))
    blocks = blocks.take(pa.array(order))
    codes, rows = np.unique(blocks["code"].to_numpy(), return_index=True)
    at, at_bytes = _bytes(blocks["at"])
    tfs, tf_bytes = _bytes(blocks["tfs"])
    first = (np.cumsum(sizes) - sizes)[np.searchsorted(heads["range_"].to_numpy(), blocks["range"].to_numpy())]
    own = {"ids": heads["ids"].combine_chunks().flatten().to_numpy(), "lengths": lengths.flatten().to_numpy(), "codes": codes, "idfs": blocks["idf"].to_numpy()[rows], "rows": rows, "first": first, "n": blocks["n"].to_numpy(), "at_bytes": at_bytes, "tf_bytes": tf_bytes}
    values = [key[0].as_py(), *(v.astype(NUMBERS[c]).tobytes() for c, v in own.items()), at, tfs]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


class _Group:
    """The postings of a group, each with what it adds to a score."""

    def __init__(self, row: dict, k1: float, b: float, mean: float):
        own = {c: np.frombuffer(row[c], kind) for c, kind in NUMBERS.items()}
        self.ids, self.codes, n = own["ids"], own["codes"], own["n"]
        ends, at_ends, tf_ends = (np.append(0, np.cumsum(x, dtype=np.int64)) for x in (n, own["at_bytes"], own["tf_bytes"]))
        self.starts = np.append(ends[own["rows"]], ends[-1])
        self.docs, self.adds = np.empty(ends[-1], np.int32), np.empty(ends[-1])
        at, tfs = np.frombuffer(row["at"], np.uint8), np.frombuffer(row["tfs"], np.uint8)
        idf, x = np.repeat(own["idfs"], np.diff(np.append(own["rows"], len(n)))), 0
        while x < len(n):
            y = max(x + 1, int(np.searchsorted(ends, ends[x] + STRETCH, "right")) - 1)
            here = slice(ends[x], ends[y])
            docs = _sums(numbers(at[at_ends[x] : at_ends[y]]), ends[x:y] - ends[x]) + np.repeat(own["first"][x:y], n[x:y])
            tf = numbers(tfs[tf_ends[x] : tf_ends[y]])
            self.docs[here] = docs
            self.adds[here] = np.repeat(idf[x:y], n[x:y]) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * own["lengths"][docs] / mean)))
            x = y
        df = np.diff(self.starts)
        self.most = np.maximum.reduceat(self.adds, self.starts[:-1])
        common = np.flatnonzero(df > len(self.ids) / COMMON)
        self.line = np.full(len(df), -1)
        self.line[common] = np.arange(len(common))
        self.common = np.zeros((len(common), len(self.ids)))
        for i, t in enumerate(common):
            mine = slice(self.starts[t], self.starts[t + 1])
            self.common[i, self.docs[mine]] = self.adds[mine]

    def best(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the k best documents of a question, and of those that
        rounding may put among them, their scores, and how many of the words
        each holds. words: places in codes."""
        lines = self.line[words]
        own, shared = words[lines < 0], words[lines >= 0]
        shared = shared[np.argsort(-self.most[shared], kind="stable")]
        lines = self.line[shared]
        rest = [0.0, *np.cumsum(self.most[shared][::-1]).tolist()][::-1]  # what the words from each one on can add
        lines = lines.tolist()
        docs, floor = np.zeros(0, np.int32), 0.0
        if len(own):
            rare = [slice(*x) for x in zip(self.starts[own].tolist(), self.starts[own + 1].tolist())]
            docs = np.concatenate([self.docs[s] for s in rare])
            sums = np.bincount(docs, np.concatenate([self.adds[s] for s in rare]), len(self.ids))
            first = np.flatnonzero(sums >= 0.85 * sums.max())
            if k <= len(first) < len(sums) / COMMON:
                whole = sums[first]
                for i in lines:
                    whole += self.common[i][first]
                floor = max(floor, float(whole.max()) if k == 1 else leading(self.ids[first], whole, k)[1])
        else:
            sums = np.zeros(len(self.ids))
        done = 0
        while True:
            at = np.flatnonzero(sums >= floor - rest[done] - SLACK)
            if done == len(lines) or len(at) < len(sums) / 4:
                break
            sums += self.common[lines[done]]
            done += 1
        scores = sums[at]
        for j in range(done, len(lines)):
            scores += self.common[lines[j]][at]
            keep = scores >= floor - rest[j + 1] - SLACK
            if np.count_nonzero(keep) < 0.75 * len(at):
                at, scores = at[keep], scores[keep]
        if k == 1 and len(at):
            floor = max(floor, float(scores.max()))
        keep = (scores > 0) & (scores >= floor - SLACK)
        at, scores = at[keep], scores[keep]
        if len(at) > 1:
            keep, _ = leading(self.ids[at], scores, k)
            at, scores = at[keep], scores[keep]
        met = [np.count_nonzero(docs == x) + np.count_nonzero(self.common[lines, x]) for x in at.tolist()]
        return at, scores, np.array(met, np.int64)


def _score(packs: pa.Table, questions: pa.Table, k: int, k1: float, b: float, mean: float) -> pa.Table:
    """(question, doc_id, score, met) of a share's questions in a group."""
    if not packs.num_rows or not questions.num_rows:
        return FOUND.empty_table()
    _trimmed()
    group = _Group({c: packs[c][0].as_buffer() for c in packs.column_names if c not in ("g", "share")}, k1, b, mean)
    out = []
    for batch in questions.to_batches():
        lists = batch.column("codes")
        codes, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        places = np.minimum(np.searchsorted(group.codes, codes), len(group.codes) - 1)
        known = group.codes[places] == codes
        ends, places = np.append(0, np.cumsum(known))[ends].tolist(), places[known]
        own = [group.best(places[x:y], k) if x < y else NONE for x, y in zip(ends, ends[1:])]
        at, scores, met = (np.concatenate(c) for c in zip(*own))
        asked = np.repeat(batch.column("question").to_numpy(), [len(x) for x, _, _ in own])
        out.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((asked, group.ids[at], scores, met), FOUND.types)], schema=FOUND))
    return pa.Table.from_batches(out, FOUND)


class ManyQuestions:
    """An index made ready for questions of these words (term); all its words
    where none are given. words: (term, df, code) of those that it holds.

    more, n and mean: (term, df) of documents beside the index, and the number
    and mean length of all, if they are to count in the weights."""

    def __init__(self, index: InvertedIndex, words: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, more: DataFrame | None = None, n: int | None = None, mean: float | None = None):
        self.spark, self.k1, self.b = index.spark, k1, b
        self.n, self.mean = (index.n if n is None else n), (index.mean if mean is None else mean) or 1.0
        df = index.terms() if more is None else index.terms().unionByName(more).groupBy("term").agg(F.sum("df").alias("df"))
        if words is not None:
            df = df.join(words.select("term").distinct(), "term", "left_semi")
        self.words = written(df.withColumn("code", F.monotonically_increasing_id()), "words")
        self.few = self.words.count() <= SMALL
        self._gather(index)

    def idf(self) -> Column:
        return F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def _sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _gather(self, index: InvertedIndex) -> None:
        """Writes the groups of ranges. A row for each range goes through the
        driver, which is one for some thousands of documents."""
        tokens = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
        g, docs, total, of = 0, 0, 0, []
        for r, n, m in index.headers().select("range", F.size("ids"), tokens).orderBy("range").collect():
            if docs and (docs + n > GROUP or total + m > TOKENS):
                g, docs, total = g + 1, 0, 0
            docs, total = docs + n, total + m
            of.append((r, g))
        self.groups = of[-1][1] + 1 if of else 0
        to = F.broadcast(self.spark.createDataFrame(of, "range bigint, g int"))
        blocks = index.blocks.filter(F.col("bucket") != HEADER).select("term", "range", "n", "at", "tfs")
        blocks = blocks.join(self._sent(self.words.select("term", "code", self.idf().alias("idf"))), "term").join(to, "range").drop("term")
        # columns of their own names, as both sides come from one table
        heads = index.headers().join(to, "range").select(F.col("g").alias("g_"), F.col("range").alias("range_"), F.col("ids").alias("ids"), F.col("lengths").alias("lengths"))
        pack = lambda key, blocks, heads: _pack(key, blocks, heads)
        self.packs = written(blocks.groupBy("g").cogroup(heads.groupBy("g_")).applyInArrow(pack, PACKED), "packs")

    def best(self, queries: DataFrame, k: int = 1) -> DataFrame:
        """(qid, doc_id, score, rk, met): BM25 of queries (qid, input). met: how
        many of a query's words the document holds."""
        asked = query_terms(queries).join(self._sent(self.words.select("term", "code")), "term")
        asked = asked.groupBy("qid").agg(F.sort_array(F.collect_list("code")).alias("codes"))
        asked = written(asked.withColumn("question", F.monotonically_increasing_id()), "asked")
        many, cores = asked.count(), self.spark.sparkContext.defaultParallelism
        shares = max(1, -(-many // SHARE), min(-(-2 * cores // max(1, self.groups)), many // LEAST))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
        share = F.pmod(F.xxhash64("question"), F.lit(shares)).cast("int")
        left = self.packs.withColumn("share", every(shares))
        right = asked.select("question", "codes", share.alias("share_"), every(self.groups).alias("g_"))
        score = partial(_score, k=k, k1=self.k1, b=self.b, mean=self.mean)
        run = lambda packs, questions: score(packs, questions)
        found = left.groupBy("g", "share").cogroup(right.groupBy("g_", "share_")).applyInArrow(run, "question bigint, doc_id bigint, score double, met bigint")
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc_id"))
        best = found.groupBy("question", "doc_id").agg(F.max(F.struct(F.round("score", 6).alias("score"), "met")).alias("b")).select("question", "doc_id", "b.*")
        best = best.withColumn("rk", rank.cast("bigint")).filter(F.col("rk") <= k)
        return best.join(asked.select("question", "qid"), "question").select("qid", "doc_id", "score", "rk", "met")


def over_documents(docs: DataFrame, words: DataFrame, k1: float = 1.2, b: float = 0.75) -> Callable[..., DataFrame]:
    """best(queries, k): (qid, doc_id, score, rk) of queries that hold these
    words (term), by the SQL of BM25.

    Only documents whose id is in several rows, or null, are joined with the
    queries word by word; of the rows of one id those of one length are counted
    together."""
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        ready = ManyQuestions(InvertedIndex.build(docs, positions=False), words, k1, b)
        return lambda queries, k=1: ready.best(queries, k).drop("met")
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    index = InvertedIndex.build(docs.join(again, same, "left_anti"), positions=False)
    rest = written(tokenize_docs(docs.join(again, same, "left_semi")), "rest")
    more, tokens = rest.agg(F.count("*"), F.sum("dl")).first()
    postings = rest.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    postings = written(postings.join(words.select("term").distinct(), "term", "left_semi"), "postings")
    n = index.n + more
    ready = ManyQuestions(index, words, k1, b, postings.groupBy("term").agg(F.count("*").alias("df")), n, (index.mean * index.n + tokens) / n)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / ready.mean))

    def best(queries: DataFrame, k: int = 1) -> DataFrame:
        weighted = query_terms(queries).join(ready.words.select("term", ready.idf().alias("idf")), "term")
        scores = postings.join(weighted, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        every = ready.best(queries, k).select("qid", "doc_id", "score").unionByName(scores)
        return every.withColumn("rk", rank.cast("bigint")).filter(F.col("rk") <= k)

    return best
