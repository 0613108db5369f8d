"""Tables in the folder that the driver and all executors share.

Who calls written() owns the files: they stay until the folder is emptied,
since a DataFrame that is returned lazily still reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder in the
    warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file, where their number is told.
FILE_ROWS = 250_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps
    start from the files, so a lost executor costs no recomputation of what
    led to them.

    rows: about how many rows df has. They are written by as many tasks as they
    need, but a task for each core at least, where Spark would have more: on a
    local folder, Hadoop starts a process for each file that it makes."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
