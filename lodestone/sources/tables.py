"""Reading and writing the tables of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name, with its declared schema, so that no file is opened to
    infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A table as a stream of its files, so many in a batch. A stream takes a
    path for a folder unless it is a pattern; this one fits a single file too."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


def read_documents(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Documents from Parquet, ORC, JSON lines, CSV or plain text. Plain text
    is one document a file, numbered by a hash of its path."""
    if format == "text":
        files = spark.read.options(**options).text(path, wholetext=True)
        name = F.input_file_name()
        return files.select(F.xxhash64(name).alias("doc_id"), F.col("value").alias("text"), F.lit(None).cast("string").alias("lang"), name.alias("source"), F.length("value").cast("bigint").alias("n_chars"))
    schema = T._parse_datatype_string(SCHEMAS["documents"])
    return spark.read.format(format).schema(schema).options(**options).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
