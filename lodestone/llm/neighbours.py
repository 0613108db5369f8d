"""Approximate nearest neighbours by a forest of hash prefixes.

A vector has one long hash string of random-hyperplane bits in each tree. A
tree is the sorted array of these strings. A query descends in every tree to
the longest prefix that it shares with some string, then all trees ascend
together, one bit at a time, and rank by exact distance the rows that the
shorter prefix takes in.

The ascent ends where a row as near as the k-th one found so far would be in
reach of no tree with a probability of MISS at most. A row at the angle a has a
prefix of d bits in common with the query with the probability (1 - a / pi) ** d
in each tree, and the widest angle at a distance follows from the norms of the
query and of the shard. So near neighbours end it early, and vectors without
structure, or of very unequal norms, late or at the root, where it is exact.

The index is a table: rows are dealt by hash into shards of SHARD vectors, and
each shard is one row that holds the sorted arrays of its trees. A block of
queries searches every shard, and its best rows of each shard meet in a
window. A vector that very many rows share is kept with its k + 1 smallest ids,
which are all that a result can name, so no shard grows with it.

Defined cases: vectors that are null, zero or hold a null or non-finite
component take no part; vectors of different lengths are never compared; rows
with the query's own id are left out, and a row repeated in id and vector counts
once; of several query vectors with one id the smallest is taken; fewer rows
than k give as many results; an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

TREES, BITS = 64, 64
SHARD = 8192
#: Queries that search a shard in one group.
BLOCK = 1024
#: Blocks of queries that meet a shard in one group.
MEET = 64
#: How likely the ascent may leave out a row as near as the k-th found.
MISS = 0.05
SEED = 11


def hash_strings(vectors: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """BITS hyperplane bits of each vector in each tree, the first bit highest."""
    planes = np.random.default_rng((seed, vectors.shape[1])).standard_normal((trees * BITS, vectors.shape[1]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((trees, len(vectors)), np.uint64)
    for t in range(trees):
        bits = unit @ planes[t * BITS : (t + 1) * BITS].T > 0
        out[t] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


class Forest:
    """The trees of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, strings: np.ndarray):
        self.ids, self.vectors, self.order, self.strings = ids, vectors, order, strings
        self.norms = np.linalg.norm(vectors, axis=1)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES) -> Forest:
        strings = hash_strings(vectors, trees)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.uint32)
        return cls(ids, vectors, order, np.take_along_axis(strings, order.astype(np.int64), axis=1))

    def pack(self) -> dict:
        return {"ids": self.ids.tobytes(), "vectors": self.vectors.tobytes(), "orders": self.order.tobytes(), "strings": self.strings.tobytes()}

    @classmethod
    def unpack(cls, row) -> Forest:
        ids = np.frombuffer(row["ids"], np.int64)
        shaped = lambda x, kind: np.frombuffer(x, kind).reshape(-1, len(ids))
        return cls(ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), shaped(row["orders"], np.uint32), shaped(row["strings"], np.uint64))

    def longest(self, queries: np.ndarray) -> np.ndarray:
        """For each query the longest prefix that it shares with a string of
        any tree."""
        best = np.zeros(queries.shape[1], np.int64)
        for sorted_strings, q in zip(self.strings, queries):
            at = np.searchsorted(sorted_strings, q)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(sorted_strings) - 1)):
                unlike = sorted_strings[near] ^ q
                # the place of the highest set bit, half by half: exact in double precision
                high, low = (np.frexp(half.astype(np.float64))[1] for half in (unlike >> np.uint64(32), unlike & np.uint64(0xFFFFFFFF)))
                best = np.maximum(best, BITS - np.where(high > 0, high + 32, low))
        return best

    def ranges(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the bounds of the rows that share a prefix of
        the depth."""
        if depth == 0:
            return np.zeros(queries.shape, np.int64), np.full(queries.shape, len(self.ids))
        rest = np.uint64((1 << (BITS - depth)) - 1)
        lo = np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, queries & ~rest)])
        hi = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.strings, queries | rest)])
        return lo, hi

    def missed(self, norm: float, far: float, depth: int) -> float:
        """The probability that no tree reaches, at the depth, a row that is
        this far from a query of this norm, at the widest angle that it can have."""
        # at a distance the angle is widest for this norm of the row
        other = np.clip(np.sqrt(max(norm**2 - far**2, 0.0)), self.norms.min(), self.norms.max())
        angle = np.arccos(np.clip((norm**2 + other**2 - far**2) / (2 * norm * other), -1, 1))
        return (1 - (1 - angle / np.pi) ** depth) ** len(self.strings)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float = MISS) -> tuple[list[tuple], int]:
        """(query_id, vec_id, distance) of the k nearest candidates of each, and
        the number of rows ranked for all of them."""
        strings, norms = hash_strings(queries, len(self.strings)), np.linalg.norm(queries, axis=1)
        start, waiting = self.longest(strings), np.arange(len(queries))
        seen = self.ids == query_ids[:, None]
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        flat, first = self.order.ravel(), np.arange(len(self.order)) * len(self.ids)
        ranked = 0
        for depth in range(int(start.max(initial=0)), -1, -1):
            mine = waiting[start[waiting] >= depth]
            if not len(mine):
                continue
            lo, hi = self.ranges(strings[:, mine], depth)
            many = ((hi - lo).sum(axis=0) >= 2 * k) | (depth == 0)
            done = []
            for i, a, b in zip(mine[many], lo.T[many], hi.T[many]):
                # the places first + a .. first + b of all trees, one after another
                ends = np.cumsum(b - a)
                met = np.zeros(len(self.ids), bool)
                met[flat[np.repeat(first + b - ends, b - a) + np.arange(ends[-1])]] = True
                new = np.flatnonzero(met & ~seen[i])
                seen[i, new] = True
                ranked += len(new)
                at = np.concatenate([found[i][0], new])
                far = np.concatenate([found[i][1], np.sqrt(((self.vectors[new] - queries[i]) ** 2).sum(axis=1))])
                best = np.arange(len(at))
                if len(at) > k:  # all that are as near as the k-th, then ties by id
                    best = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
                best = best[np.lexsort((self.ids[at[best]], far[best]))[:k]]
                found[i] = at[best], far[best]
                if depth == 0 or (len(best) == k and self.missed(norms[i], far[best[-1]], depth) <= miss):
                    done.append(i)
            waiting = np.setdiff1d(waiting, done)
            if not len(waiting):
                break
        return [(query_ids[i], self.ids[a], f) for i, (at, far) in enumerate(found) for a, f in zip(at, far)], ranked


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def forest_index(vectors: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, trees: int = TREES) -> DataFrame:
    """The index: a row (dim, shard, ids, vectors, orders, strings) per shard."""
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()  # -0.0 becomes 0.0
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = written(rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1).select("id", "v", F.size("v").alias("dim")), "vectors")
    sizes = {r[0]: -(-r[1] // shard) for r in rows.groupBy("dim").count().collect()}
    of = F.lit(1)
    for dim, n in sizes.items():
        of = F.when(F.col("dim") == dim, n).otherwise(of)

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        forest = Forest.build(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64), trees)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], **forest.pack()}])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("v"), of).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, vectors binary, orders binary, strings binary")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each query
    by Euclidean distance, ties to the smaller id."""
    rows = queries.select(F.col(id).cast("bigint").alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows = written(rows, "queries")
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def bundle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame([{"dim": key[0], "block": key[1], "query_ids": pdf["id"].to_numpy(np.int64).tobytes(), "queries": v.tobytes()}])

    bundles = rows.groupBy("dim", "block").applyInPandas(bundle, "dim int, block int, query_ids binary, queries binary")
    # blocks of the stated query set meet every shard: they are copied, and a
    # shard goes once to each group of MEET blocks
    last = {r[0]: r[1] for r in index.groupBy("dim").agg(F.max("shard")).collect()}
    of = F.lit(None).cast("int")
    for dim, shard in last.items():
        of = F.when(F.col("dim") == dim, shard).otherwise(of)
    shards = index.withColumn("meet", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // MEET))))
    asked = bundles.withColumn("meet", F.expr(f"block div {MEET}").cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), of)))

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(shard) and len(asked):
            forest = Forest.unpack(shard.iloc[0])
            for own, data in zip(asked["query_ids"], asked["queries"]):
                ids = np.frombuffer(own, np.int64)
                got += forest.search(ids, np.frombuffer(data, np.float64).reshape(len(ids), -1), k, miss)[0]
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "shard", "meet"]
    found = shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_prefix_forest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index = written(forest_index(vectors), "index")
    return nearest(index, vectors.filter(F.col("vec_id") % 100 == 0))
