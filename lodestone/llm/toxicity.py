"""Toxicity by weak supervision.

From a bounded sample of labelled rows come terms that toxic texts hold more
often. They make the lexicons of many voters, which with pattern voters vote
on each sampled text: toxic, harmless or no vote. A generative label model
estimates by EM how often each voter votes what on toxic and harmless texts,
and how voters correlate given the class; correlated voters share their weight.
A logistic regression on the terms is then fitted to the model's posterior
labels, and scores every whole text where it is read.

The lexicons' terms are mined with the sampled labels, so the supervision is
weak in what it takes from a text, not free of labels.

SAMPLE bounds the documents that anything is fitted on, TERMS the terms that the
score knows; both are documented parameters. Scoring is one pass without a
shuffle. Labels of rows whose crc32(doc_id as text) is divisible by FOLDS are
never read, and no column but the text enters a score.

Defined cases: a null text counts as empty and gets the score of a text without
terms; a null id is not held out and never sampled; repeated rows get equal
scores; without labelled rows every score is that of the prior; an empty table
gives an empty table; extra columns are left out.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import whole_text, written

FOLDS = 5
SAMPLE = 20_000
TERMS = 6_000
#: A term needs this significance, the root of the likelihood ratio statistic:
#: high, as of very many terms some tell by chance. A voter's also these log odds.
LEAST_Z, LEAST_ODDS = 5.0, 3.5
#: Terms: whole words, and beginnings of words of these lengths.
STEMS = (4, 5, 6, 8)
LEXICONS = 5
MARKS = ".,;:!?\"'()[]{}*%&$#|<>«»¿¡-"
#: Voters beside the lexicons.
PATTERNS = ("no_word", "no_stem4", "no_stem5", "no_stem6", "no_stem8", "many_terms", "several_kinds", "shouting", "second_person")
# Words that address the reader.
YOU = frozenset("you your du dein deine dich tu toi vous votre usted tus eres".split())
PRIOR = 0.05


def words_in(text: str) -> set[str]:
    """Distinct words, lower-cased, less the marks around them."""
    return {w.strip(MARKS) for w in set(text.lower().split())} - {""}


def terms_of(word: str) -> list[str]:
    return ["w:" + word] + [f"{n}:{word[:n]}" for n in STEMS if len(word) > n]


def held_out(id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % folds == 0, F.lit(False))


class TermCache:
    """Word -> numbers of its known terms; forgets when it grows large."""

    def __init__(self, known: dict[str, int], most: int = 400_000):
        self.known, self.most, self.seen = known, most, {}

    def of(self, word: str) -> tuple[int, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            got = self.seen[word] = tuple(self.known[t] for t in terms_of(word) if t in self.known)
        return got

    def terms(self, text: str) -> set[int]:
        of, out = self.of, set()
        for word in words_in(text):
            if got := of(word):
                out.update(got)
        return out


def mine_terms(sample: DataFrame, terms: int = TERMS) -> list[tuple[str, float, float]]:
    """(term, log odds, z) of the terms of the sampled rows (text, toxic) that
    tell most, at most `terms`."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)

    def count(batches):
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts[toxic].update({t for w in words_in(text) for t in terms_of(w)})
        every = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"term": every, "p": [counts[1][t] for t in every], "n": [counts[0][t] for t in every]}).astype({"term": "str", "p": "int64", "n": "int64"})

    c = sample.select("text", "toxic").mapInPandas(count, "term string, p bigint, n bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (neg - F.col("n") + 0.5))
    both = F.col("p") + F.col("n")
    part = lambda c, total: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (pos + neg) / (both * total))).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("p", pos) + part("n", neg))))
    c = c.filter("p + n >= 3").select("term", odds.alias("odds"), z.alias("z")).filter(F.col("z") >= LEAST_Z)
    return [tuple(r) for r in c.orderBy(F.desc("z"), "term").limit(terms).collect()]


class Voters:
    """Votes 1 (toxic), -1 (harmless) or 0 (none) on a text."""

    def __init__(self, mined):
        self.cache = TermCache({t: i for i, (t, _, _) in enumerate(mined)})
        self.kinds = ["w", *map(str, STEMS)]
        self.voter = {}  # term number -> (kind, lexicon)
        for i, (term, odds, z) in enumerate(mined):
            if odds >= LEAST_ODDS:
                self.voter[i] = self.kinds.index(term.partition(":")[0]), zlib.crc32(term.encode()) % LEXICONS
        self.held = {kind for kind, _ in self.voter.values()}  # a kind without terms never votes
        self.names = [f"lexicon_{k}_{j}" for k in self.kinds for j in range(LEXICONS)] + list(PATTERNS)

    def vote(self, text: str, terms: set[int]) -> list[int]:
        hits = [self.voter[i] for i in terms if i in self.voter]
        lexicons = [0] * (len(self.kinds) * LEXICONS)
        for kind, j in hits:
            lexicons[kind * LEXICONS + j] = 1
        by_kind = Counter(k for k, _ in hits)
        words = text.lower().split()
        return lexicons + [
            *(-1 if k in self.held and not by_kind[k] else 0 for k in range(len(self.kinds))),
            1 if len(hits) >= 4 else 0,
            1 if len(by_kind) >= 2 else -1 if not by_kind else 0,
            1 if words and text.count("!!") > 0.3 * len(words) else 0,
            (1 if hits else -1) if YOU.intersection(words) else 0,
        ]


class LabelModel:
    """Voters as noisy channels of the hidden class, fitted by EM."""

    def __init__(self, votes: np.ndarray, rounds: int = 25, prior: float = PRIOR):
        one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # rows, voters, votes
        y = np.clip(np.where(votes.sum(axis=1) > 0, 0.95, prior), 0.01, 0.99)
        self.weight = np.ones(votes.shape[1])
        for _ in range(rounds):
            self.prior = float(np.clip(y.mean(), 1e-3, 0.5))
            self.rates = np.stack([((1 - y) @ one.reshape(len(y), -1)), y @ one.reshape(len(y), -1)]).reshape(2, *one.shape[1:])
            # shrunk to the voter's votes over both classes: one that always votes alike tells nothing
            overall = (one.sum(axis=0) + 1e-3) / (len(y) + 3e-3)
            self.rates = (self.rates + 0.3 * overall) / (self.rates.sum(axis=2, keepdims=True) + 0.3)
            self.weight = 1 / self._dependence(votes, y)
            y = self._posterior(one)
        self.labels = y

    def _dependence(self, votes, y) -> np.ndarray:
        """1 and the sum of a voter's positive correlations with others given
        the class."""
        value = np.array([-1.0, 0.0, 1.0])
        mean = self.rates @ value  # class, voter
        rest = votes - ((1 - y)[:, None] * mean[0] + y[:, None] * mean[1])
        size = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        r = (rest.T @ rest) / np.outer(size, size)
        np.fill_diagonal(r, 0)
        self.correlation = r
        return 1 + np.where(np.abs(r) > 0.1, np.abs(r), 0).sum(axis=1)

    def _posterior(self, one) -> np.ndarray:
        told = (one * np.log(self.rates[1] / self.rates[0])).sum(axis=2) @ self.weight
        return 1 / (1 + np.exp(-np.clip(told + math.log(self.prior / (1 - self.prior)), -30, 30)))


def fit_linear(rows: list[list[int]], labels: np.ndarray, terms: int, rounds: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of terms, by Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), np.int64)
    w, g1, g2 = np.zeros(terms + 1), np.zeros(terms + 1), np.zeros(terms + 1)
    w[-1] = math.log(PRIOR / (1 - PRIOR))
    for k in range(1, rounds + 1 if len(rows) else 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.append(np.bincount(col, off[at], terms), off.sum()) / len(rows) + l2 * np.append(w[:-1], 0)
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        w -= 0.1 * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


class Toxicity:
    """A fitted model; see the module's text."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, folds: int = FOLDS):
        marked = labels.filter(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
        few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
        # `sample` rows of two numbers: a bounded table; an id that many rows have gives one text
        texts = docs.select("doc_id", whole_text().alias("text"))
        rows = texts.join(F.broadcast(few), F.col("doc_id") == F.col("id"))
        rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
        rows = written(rows, "sample")
        mined = mine_terms(rows, terms)
        voters = Voters(mined)

        def vote(batches):
            for batch in batches:
                terms = [sorted(voters.cache.terms(t)) for t in batch["text"]]
                yield pd.DataFrame({"votes": [voters.vote(t, set(x)) for t, x in zip(batch["text"], terms)], "terms": terms})

        seen = rows.select("text").mapInPandas(vote, "votes array<int>, terms array<int>").collect()  # of the sample
        self.terms = [t for t, _, _ in mined]
        if seen:
            self.label_model = LabelModel(np.array([r["votes"] for r in seen], float))
            self.weights, self.bias = fit_linear([r["terms"] for r in seen], self.label_model.labels, len(mined))
        else:
            self.label_model, self.weights, self.bias = None, np.zeros(0), math.log(PRIOR / (1 - PRIOR))

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        known, weights, bias = {t: i for i, t in enumerate(self.terms)}, self.weights, self.bias

        @F.pandas_udf("double")
        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = TermCache(known)
            for texts in batches:
                yield pd.Series([1 / (1 + math.exp(-min(30.0, max(-30.0, bias + sum(weights[i] for i in cache.terms(t)))))) for t in texts.fillna("")], dtype="float64")

        return docs.withColumn(score, judge(F.col(text).cast("string")))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = Toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    df = model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
