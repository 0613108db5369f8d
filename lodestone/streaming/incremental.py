"""A forward index that is kept up to date by a stream of changed documents.

Changes are (doc_id, text, version, deleted). A batch is tokenized where it is
read and written as one more segment, without a shuffle and without a look at
what is there. Which row of a document counts is decided when the index is read:
the one of the largest version, of equal versions a deletion, then the text of
the largest MD5. So batches may come late, twice or in any split, and the index
is that of all changes at once. A deletion stays as a tombstone. compact() writes
what counts as one segment and retires the ones that it read.

A log says which segments count, one row for each batch or compaction, written
after its files; what a run that died has left is in no row and is not read. A
stream may go on while segments are compacted.

Defined cases: rows without an id are left out; a null version is the smallest, a
null text is empty, a null `deleted` is no deletion; repeated rows are one
document; an empty batch or table adds none; other columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import term_counts, tokens
from lodestone.operators.terms import Index, spread
from lodestone.sources.shared import shared_path, written

#: Rows that have lost up to which their places are sent to all tasks.
SMALL = 200_000
ROWS = "doc_id bigint, version bigint, deleted boolean, digest string, place bigint, dl bigint, terms array<struct<term: string, tf: bigint>>"
LOG = "segment string, retired array<string>, floor bigint"
LOWEST = -(1 << 63)


class SegmentedIndex:
    """The index in a folder that the driver and all executors share. A new
    folder is an empty index."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "segments")
        spark.createDataFrame([], LOG).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame, retired: list[str], floor: int | None = None) -> None:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/rows/segment={name}")
        entry = rows.sparkSession.createDataFrame([(name, retired, floor)], LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _log(self) -> tuple[list[str], set[str], int]:
        """The segments that count, those of them that a compaction wrote, and
        the version below which later rows are too late."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()  # a row for each batch
        gone = {name for r in log for name in r.retired}
        floor = max((r.floor for r in log if r.floor is not None), default=LOWEST)
        return sorted(r.segment for r in log if r.segment not in gone), {r.segment for r in log if r.retired}, floor

    def segments(self) -> list[str]:
        return self._log()[0]

    def add(self, changes: DataFrame) -> None:
        """One batch of changes as a segment."""
        text = F.coalesce("text", F.lit(""))
        gone = F.coalesce("deleted", F.lit(False))
        own = spread(changes).filter("doc_id is not null").select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("version", F.lit(LOWEST)).cast("bigint").alias("version"), gone.alias("deleted"),
            F.md5(text).alias("digest"), F.when(gone, F.array().cast("array<string>")).otherwise(F.array_sort(tokens(text))).alias("words"),
        )
        counted = own.select("doc_id", "version", "deleted", "digest", F.monotonically_increasing_id().alias("place"), F.size("words").cast("bigint").alias("dl"), term_counts(F.col("words")).alias("terms"))
        self._write(counted, [])

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds each batch of a stream of changes. A batch that runs again after
        a restart adds its rows once more, which changes nothing."""
        writer = changes.writeStream.foreachBatch(lambda batch, _: self.add(batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _rows(self, segments: list[str]) -> DataFrame:
        schema = f"{ROWS}, segment string"
        if not segments:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/rows"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/segment={s}" for s in segments])

    def _current(self) -> tuple[DataFrame, list[str], int]:
        """The row that counts of each document, tombstones too. Only what has
        lost leaves the scan, by a join with its place; documents of one row,
        which are most, are not in that join's other side."""
        segments, packed, floor = self._log()
        rows = self._rows(segments)
        if len(segments) == 1 and segments[0] in packed:
            return rows, segments, floor
        if floor > LOWEST:
            rows = rows.filter(F.col("segment").isin(sorted(packed)) | (F.col("version") >= floor))
        order = F.struct("version", "deleted", "digest", "segment", "place")
        heads = rows.select("doc_id", order.alias("order"))
        several = heads.groupBy("doc_id").agg(F.max("order").alias("best"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "best")
        lost = written(heads.join(several, "doc_id").filter("order < best").select("order.segment", "order.place"), "lost")
        few = lost.limit(SMALL + 1).count() <= SMALL  # so no row that counts is shuffled
        return rows.join(F.broadcast(lost) if few else lost, ["segment", "place"], "left_anti"), segments, floor

    def open(self) -> Index:
        """What the rankers read, as the index is now."""
        return Index.of(self._current()[0].filter("not deleted").select("doc_id", "dl", "terms"))

    def compact(self, forget: int | None = None) -> None:
        """One segment in place of all that are there now. Tombstones of
        versions below `forget` go too; from then on rows of such versions are
        too late and change nothing."""
        rows, segments, floor = self._current()
        if forget is not None:
            floor = max(floor, forget)
            rows = rows.filter(~F.col("deleted") | (F.col("version") >= floor))
        # a scan packs small files into tasks of an even size, and each writes one
        whole = rows.select("doc_id", "version", "deleted", "digest", F.monotonically_increasing_id().alias("place"), "dl", "terms")
        self._write(whole, segments, floor if floor > LOWEST else None)
