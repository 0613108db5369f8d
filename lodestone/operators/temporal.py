"""Joins by time: for each row the latest row of another table before it, and
all points that lie within intervals; and sessions.

Defined cases of the as-of join: rows without a key or a time find nothing; of
right rows with one key and time the largest counts, by its columns in order;
repeated left rows are given each; empty tables give no rows, or left rows that
found nothing. Of the interval join: a bound or point that is null, or an
interval that ends where it starts or before, meets nothing; an interval longer
than a long is an error; repeated rows meet each; empty tables give no rows. Of
sessions: rows without a key or a time are in none; repeated rows count each; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written

#: Rows of both tables in a range, on average at most.
RANGE = 500_000


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, columns: list[str], rows: int = RANGE) -> DataFrame:
    """left with these columns of the latest right row of the same key whose
    time is not later; null where there is none.

    Both tables are put in order by ranges of key, time and a random number, so
    a key with a third of all rows is several ranges. Within a range the last
    right row is carried on by a window over the key; what a range hands on to
    later ones of its last key is a row for each range and key."""
    kept = [c for c in left.columns if c not in (by, time)]
    got = right.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).groupBy(by, time).agg(F.max(F.struct(*columns)).alias("found"))
    seen = got.select(F.col(by).alias("key"), F.col(time).alias("at"), F.lit(0).alias("side"), "found", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("row"))
    asked = left.select(F.col(by).alias("key"), F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(got.schema["found"].dataType).alias("found"), F.struct(*left.columns).alias("row"))
    every = written(seen.unionByName(asked).withColumn("salt", F.rand()), "asof")
    parts = max(-(-every.count() // rows), every.sparkSession.sparkContext.defaultParallelism)
    order = ["key", "at", "side", "salt"]  # a right row of the same time comes first
    ranged = every.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("place", 33).cast("int")).drop("salt"), "ranged")
    within = Window.partitionBy("part", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.withColumn("found", F.last("found", ignorenulls=True).over(within)).filter("side = 1")
    # what earlier ranges of a key hand on
    ends = ranged.filter("key is not null").groupBy("part", "key").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("place"))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("handed", F.last("last", ignorenulls=True).over(before)).filter("handed is not null").select("part", "key", "handed")
    found = carried.join(handed, ["part", "key"], "left").withColumn("found", F.when(F.col("at").isNotNull(), F.coalesce("found", "handed")))
    return found.select(*[F.col("row")[c].alias(c) for c in [by, time, *kept]], *[F.col("found")[c].alias(c) for c in columns])


def interval_join(intervals: DataFrame, points: DataFrame, start: str, stop: str, at: str) -> DataFrame:
    """Pairs (all columns of both, which must have names of their own) with
    start <= at < stop, of whole numbers.

    An interval belongs to the level of the least power of two that is not
    shorter than it, and so to two cells of that width at most; a point has one
    cell on each level that occurs, of which there are 64 at most. Cells meet in
    an equality join and the bounds decide, so no side is compared with all of
    the other, and a long interval costs no more rows than a short one. A first
    and a second cell are told apart by the check alone, as they differ."""
    # binary digits of the length less one: a logarithm would be rounded
    digits = F.length(F.bin(F.col(stop) - F.col(start) - 1))
    sized = intervals.filter(F.col(start) < F.col(stop)).withColumn("level_", F.when(F.col(stop) - F.col(start) == 1, 0).otherwise(digits))
    levels = sorted(r[0] for r in sized.select("level_").distinct().collect())
    cell = lambda value: F.expr(f"shiftright({value}, level_)")
    cells = sized.withColumn("cell_", F.explode(F.array_distinct(F.array(cell(f"`{start}`"), cell(f"(`{stop}` - 1)")))))
    spots = points.filter(F.col(at).isNotNull()).withColumn("level_", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell_", cell(f"`{at}`"))
    met = cells.join(spots, ["level_", "cell_"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop)))
    return met.drop("level_", "cell_")


def sessions(events: DataFrame, by: str, time: str, gap: int, told: list[Column], rows: int = RANGE) -> DataFrame:
    """(by, start, stop, n, told): the rows of a key of which each comes at most
    `gap` after the one before, as a session from its first time to its last
    with the aggregates `told`. Times are whole numbers.

    Rows are put in order by ranges of key, time and a random number, so a key
    with a third of all rows is several ranges. A window finds the sessions
    within a range; only the first one of a range's first key can go on from
    the range before. Those are one row a range at most, so they are sent to all
    tasks, and the aggregates are summed by Spark within the tasks first."""
    salted = written(events.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).withColumn("salt_", F.rand()), "events")
    parts = max(-(-salted.count() // rows), salted.sparkSession.sparkContext.defaultParallelism)
    order = [by, time, "salt_"]
    ranged = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    ranged = ranged.withColumn("part_", F.shiftright("place_", 33).cast("int")).drop("salt_")
    within = Window.partitionBy("part_", by).orderBy("place_")
    opens = F.coalesce(F.col(time) - F.lag(time).over(within) > gap, F.lit(True))
    marked = ranged.withColumn("opens_", F.when(opens, F.col(time)))
    marked = written(marked.withColumn("start_", F.last("opens_", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))), "marked")
    # keys of several ranges: where the first session of each range begins
    ends = marked.groupBy(by, "part_").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max("opens_").alias("latest"))
    several = ends.join(ends.groupBy(by).agg(F.count("*").alias("ranges")).filter("ranges > 1"), by)
    along = Window.partitionBy(by).orderBy("part_")
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(along) <= gap, F.lit(False))
    # the start of a range's last session, where the range itself tells it
    own = F.when((F.col("latest") > F.col("first")) | ~F.col("goes_on"), F.col("latest"))
    chained = several.withColumn("goes_on", goes_on).withColumn("own", own)
    moved = chained.withColumn("begun_", F.last("own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).filter("goes_on")
    moved = moved.select(by, "part_", F.col("first").alias("start_"), "begun_")
    whole = marked.join(F.broadcast(moved), [by, "part_", "start_"], "left").withColumn("start", F.coalesce("begun_", "start_"))
    return whole.groupBy(by, "start").agg(F.max(time).alias("stop"), F.count("*").alias("n"), *told)
