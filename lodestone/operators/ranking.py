"""Lexical and vector ranking, fusion and re-ranking.

Queries are (qid, input). Every ranker returns (qid, doc_id, score, rk): scores
are rounded before they are ranked, and ties go to the smaller id, so results
do not depend on the order in which partial sums arrive. Documents of equal ids
are scored as one, their terms added up; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.terms import Index

#: Terms of queries up to which they are sent to all tasks.
SMALL = 100_000

def top_k(scored: DataFrame, k: int, digits: int = 6, doc: str = "doc_id") -> DataFrame:
    """The k best of each query; Spark limits each task's groups to k rows
    before it shuffles."""
    rounded = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), doc))
    return rounded.withColumn("rk", rank.cast("bigint")).filter(F.col("rk") <= k).select("qid", doc, "score", "rk")


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct terms of each query, repeated rows once."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("input")))).alias("term")).distinct()


def bm25(index: Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 (Robertson and Zaragoza 2009), idf = ln(1 + (N - df + .5) / (df + .5)).

    Only postings of terms that some query holds leave the index's scan, so
    what is shuffled follows the queries' terms and not the vocabulary. Where
    they are few, they are sent to all tasks, and no posting is shuffled before
    its document's terms are added up."""
    terms = query_terms(queries)
    sent = F.broadcast if terms.limit(SMALL + 1).count() <= SMALL else lambda df: df
    found = index.postings().join(sent(terms.select("term").distinct()), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").select("qid", "term", F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.mean or 1.0)))
    scores = found.join(sent(weighted), "term").groupBy("qid", index.id).agg(F.sum(part).alias("score"))
    return top_k(scores, k, doc=index.id)


def tfidf_cosine(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Cosine of weights (1 + ln tf) ln(1 + N / df); a query's terms that no
    document holds carry no weight. Postings of other terms are read for the
    documents' norms only, once for an index."""
    counted = queries.select("qid", F.explode(tokens(F.col("input"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    found = index.postings().join(counted.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    qw = counted.join(df, "term").withColumn("idf", F.log(1 + F.lit(index.n) / F.col("df")))
    qw = qw.select("qid", "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("qw"))
    qn = qw.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = found.join(qw, "term").groupBy("qid", index.id).agg(F.sum((1 + F.log("tf")) * F.col("idf") * F.col("qw")).alias("dot"))
    scores = dot.join(index.norms(), index.id).join(qn, "qid").select("qid", index.id, (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))
    return top_k(scores, k, doc=index.id)


def _usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, dict[int, int]]:
    """(dim, b, ids, vectors): rows (id, v) packed as binary, `block` or so in
    each, and how many blocks each dimension has."""
    rows = rows.withColumn("dim", F.size("v"))
    many = {r[0]: -(-r[1] // block) for r in rows.groupBy("dim").count().collect()}  # a row for each dimension
    of = F.lit(1)
    for dim, n in many.items():
        of = F.when(F.col("dim") == dim, n).otherwise(of)

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": key[0], "b": key[1], "ids": pdf["id"].to_numpy(np.int64).tobytes(), "vectors": np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()}])

    packed = rows.withColumn("b", F.pmod(F.xxhash64("id", "v"), of).cast("int")).groupBy("dim", "b").applyInPandas(pack, "dim int, b int, ids binary, vectors binary")
    return packed, many


def dense_knn(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, asked_at_once: int = 65536) -> DataFrame:
    """(qid, vec_id, score, rk): exact cosine search of a stated query set
    against all rows, in blocks; self excluded.

    Vectors travel as packed blocks. A group holds one block of rows and at
    most about asked_at_once queries; only its k best of each query leave it.
    Vectors that are null, zero or hold null or non-finite components take no
    part; vectors of different lengths are never compared; of rows with one id
    the smallest vector counts as the query."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(_usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(_usable(F.col("v")) & F.col("id").isNotNull())
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    (base, n), (small, m) = _blocks(rows, block), _blocks(asked, min(1024, block))
    each = asked_at_once // min(1024, block)
    per = lambda many: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (many or {0: 0}).items() for x in p]), F.col("dim")), F.lit(0))
    left = base.withColumn("g", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(per(m), F.lit(1)) - 1) / each).cast("int"))))
    right = small.filter(per(n) > 0).withColumn("g", F.floor(F.col("b") / each).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.greatest(per(n), F.lit(1)) - 1)))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        dim = int(rows["dim"][0])

        def unit(data):
            v = np.frombuffer(data, np.float64).reshape(-1, dim)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # first, as squares of large components are infinite
            return v / np.linalg.norm(v, axis=1, keepdims=True)

        ids, base, out = np.frombuffer(rows["ids"][0], np.int64), unit(rows["vectors"][0]), []
        for own, data in zip(asked["ids"], asked["vectors"]):
            for q, v in zip(np.frombuffer(own, np.int64), unit(data)):
                s = np.round(base @ v, 6)
                s[ids == q] = -np.inf
                best = np.lexsort((ids, -s))[:k]
                out += [(q, ids[x], s[x]) for x in best if s[x] > -np.inf]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"])

    found = left.groupBy("dim", "b", "g").cogroup(right.groupBy("dim", "b", "g")).applyInPandas(search, "qid bigint, vec_id bigint, score double")
    return top_k(found, k, doc="vec_id")


def rrf(*rankings: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al. 2009): the sum of 1 / (60 + rank)."""
    every = rankings[0].select("qid", "doc_id", "rk")
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", "doc_id", "rk"))
    return top_k(every.groupBy("qid", "doc_id").agg(F.sum(1 / (constant + F.col("rk"))).alias("score")), k, digits=8)


def mmr(hits: DataFrame, index: Index, k: int = 5, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance (Carbonell and Goldstein 1998) over the hits
    of a query: greedy picks of relevance, scaled by the best score, less
    likeness to what was picked (Jaccard of terms). A group is one query's
    hits, a few rows; of repeated documents each counts."""
    rows = hits.join(index.docs.select(index.id, F.col("terms.term").alias("terms")), index.id)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        sets = [set(t) for t in pdf["terms"]]
        like = np.array([[len(a & b) / max(1, len(a | b)) for b in sets] for a in sets])
        relevance = pdf["score"].to_numpy() / max(pdf["score"].max(), 1e-12)
        left, out = list(range(len(pdf))), []
        while left and len(out) < k:
            value = {i: round(trade * relevance[i] - (1 - trade) * max((like[i][j] for j, _ in out), default=0.0), 6) for i in left}
            best = max(left, key=lambda i: (value[i], -i))
            out.append((best, value[best]))
            left.remove(best)
        return pd.DataFrame([(pdf["qid"][i], pdf["doc_id"][i], v, r) for r, (i, v) in enumerate(out, 1)], columns=["qid", "doc_id", "score", "rk"])

    return rows.groupBy("qid").applyInPandas(pick, "qid bigint, doc_id bigint, score double, rk bigint")
