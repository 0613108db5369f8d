"""Answers of several sentences by their centrality in a sentence graph.

Defined cases: null texts have no sentences; a question none of whose words a
sentence holds has no answer; repeated sentences count each; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.sources.shared import written

#: A sentence ends after a mark that white space follows, or with its line.
BREAK = r"(?<=[.!?])\s+|\n+"


def candidates(hits: DataFrame, docs: DataFrame, queries: DataFrame, most: int = 48) -> DataFrame:
    """(qid, node, doc_id, place, sentence, terms, overlap): of the sentences of a
    question's hits those that share most words with it, ties to the better hit
    and the earlier sentence. Only the hits' texts are read."""
    text = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", BREAK)).alias("place", "sentence"))
    text = text.withColumn("terms", F.array_distinct(tokens(F.col("sentence")))).filter(F.size("terms") > 0)
    asked = queries.select("qid", F.array_distinct(tokens(F.col("input"))).alias("asked"))
    met = hits.select("qid", "doc_id", "rk").join(text, "doc_id").join(asked, "qid").withColumn("overlap", F.size(F.array_intersect("terms", "asked"))).filter("overlap > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "rk", "place"))
    return met.withColumn("node", rank).filter(F.col("node") <= most).select("qid", "node", "doc_id", "rk", "place", "sentence", "terms")


def similarities(nodes: DataFrame) -> DataFrame:
    """(qid, a, b, w): sentences of a question with words in common, both ways;
    the cosine of their sets of words. A question has as many nodes as
    candidates() keeps, so a word's pairs are bounded too."""
    words = nodes.select("qid", "node", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    left, right = words.toDF("qid", "a", "na", "term"), words.toDF("qid", "b", "nb", "term")
    shared = left.join(right, ["qid", "term"]).filter("a <> b").groupBy("qid", "a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return shared.select("qid", "a", "b", (F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).alias("w"))


def central_sentences(hits: DataFrame, docs: DataFrame, queries: DataFrame, keep: int = 3, most: int = 48, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """(qid, answer, n_sentences): the `keep` most central sentences of each
    question's hits (LexRank; Erkan and Radev 2004), in the order of hits and of
    the text. A group is one question's graph of at most `most` nodes."""
    nodes = written(candidates(hits, docs, queries, most), "sentences")
    kind = queries.schema["qid"].dataType.simpleString()

    def rank(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        n = len(nodes)
        nodes = nodes.sort_values("node").reset_index(drop=True)
        a, b, w = edges["a"].to_numpy(np.int64) - 1, edges["b"].to_numpy(np.int64) - 1, edges["w"].to_numpy(np.float64)
        out = np.bincount(a, w, n)
        r = np.full(n, 1.0 / n)
        for _ in range(rounds):  # a sentence without neighbours gives to all alike
            r = (1 - damping) / n + damping * (np.bincount(b, r[a] * w / out[a], n) + r[out == 0].sum() / n)
        best = np.lexsort((np.arange(n), -np.round(r, 9)))[:keep]
        chosen = nodes.iloc[best].sort_values(["rk", "place"])
        return pd.DataFrame({"qid": [nodes["qid"][0]], "answer": [" ".join(s.strip() for s in chosen["sentence"])], "n_sentences": [len(chosen)]})

    def each(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return rank(nodes, edges) if len(nodes) else pd.DataFrame({"qid": [], "answer": [], "n_sentences": []})

    return nodes.select(F.col("qid").alias("qid"), "node", "rk", "place", "sentence").groupBy("qid").cogroup(similarities(nodes).groupBy("qid")).applyInPandas(each, f"qid {kind}, answer string, n_sentences bigint")
