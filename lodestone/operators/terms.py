"""Terms of documents: the forward index, term statistics and passages.

Defined cases: a null text counts as empty and has no terms; repeated rows
count each; an empty table gives empty results; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_array, term_counts, tokens
from lodestone.sources.shared import written


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt over the cores where its scan has fewer partitions than there
    are cores: a small table may sit in one row group, which one task would
    tokenize. A larger table is left as it is, so no text of it is shuffled."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenize_docs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens, dl): the tokens of each document and their number."""
    return docs.select(F.col(id), tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))


class Index:
    """The forward index of some documents, written once to the shared folder:
    a row (id, dl, terms: array of (term, tf)) for each. Rankers read it and
    never a text, so a corpus is tokenized once however many rankers run."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text"):
        self.id = id
        ordered = docs.select(id, F.array_sort(tokens(F.col(text))).alias("words"))
        self._set(written(ordered.select(id, F.size("words").cast("bigint").alias("dl"), term_counts(F.col("words")).alias("terms")), "index"))

    @classmethod
    def of(cls, rows: DataFrame, id: str = "doc_id") -> Index:
        """An index over rows (id, dl, terms) that are there already."""
        index = cls.__new__(cls)
        index.id = id
        index._set(rows)
        return index

    def _set(self, rows: DataFrame) -> None:
        self.docs = rows
        told = rows.agg(F.count("*"), F.avg("dl")).first()
        self.n, self.mean = told[0], told[1] or 0.0
        self._norms = None

    def postings(self) -> DataFrame:
        """(id, dl, term, tf): how often each document has each of its terms."""
        return self.docs.select(self.id, "dl", F.explode("terms").alias("p")).select(self.id, "dl", "p.term", "p.tf")

    def idf(self) -> DataFrame:
        """(term, idf): ln(1 + N / df)."""
        df = self.docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return df.select("term", F.log(1 + F.lit(self.n) / F.col("df")).alias("idf"))

    def norms(self) -> DataFrame:
        """(id, norm): the length of each document's vector of (1 + ln tf) idf;
        written once. The squares are summed within the tasks first."""
        if self._norms is None:
            w = (1 + F.log("tf")) * F.col("idf")
            self._norms = written(self.postings().join(self.idf(), "term").groupBy(self.id).agg(F.sqrt(F.sum(w * w)).alias("norm")), "norms")
        return self._norms


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term. No filter is derived from
    explode_outer, so a text is split once."""
    terms = docs.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter("term is not null")


def chunk_docs(docs: DataFrame, size: int = 64, stride: int = 48) -> DataFrame:
    """(doc_id, chunk_ix, chunk): overlapping passages."""
    split = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    made = split.select("doc_id", F.explode_outer(chunk_array(F.col("words"), size, stride)).alias("c"))
    return made.filter("c is not null").select("doc_id", "c.chunk_ix", "c.chunk")
