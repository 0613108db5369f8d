"""The corpus pipeline: from raw documents to packed training sequences.

Each stage reads all that the one before kept, which was written as Parquet to
the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, pii, quality, simhash
from lodestone.llm.common import fresh_name, written


#: Rows that Spark sends to Python at once: ten thousand whole texts, its usual
#: number, take memory in the executor and in each Python worker, which stays.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends BATCH rows at once, if not fewer. It is a
    setting of the session as the stages' results are lazy; no result depends
    on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule accepts. A null or empty text is
    rejected; repeated rows are judged alike; other columns pass through."""
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a
    similarity of 0.8 or more. A null text counts as empty, and all texts
    without words are one group; of repeated rows one stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars, where there
    is such a column, follows the text. A null text stays null; repeated rows
    are treated alike."""
    small_batches(spark)
    clean = pii.detect(docs, spans=fresh_name(docs, "spans"), redact=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights; a row for each epoch. A null
    language or source counts as "other"; a null or empty text has no tokens;
    repeated rows are taken each."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source")
    return mixing.mix(row).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in
    sequences. A null text is its end token alone; repeated rows are packed
    each; other columns are left out."""
    small_batches(spark)
    return packing.pack_documents(docs, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL has no tokenizer and no minimum bin slack; the tests compare the stages
#: with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
