"""Sessions against a plain version, whatever the ranges; the stream against the batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.temporal import sessions
from lodestone.sources.shared import shared_path
from lodestone.streaming.sessions import stream_sessions

EVENTS = "u long, t long, v long, start string, n string, part string, first int"


def plain(rows, gap):
    out, last = [], {}
    for u, t, v in sorted((r[:3] for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:2]):
        if u in last and t - last[u][2] <= gap:
            last[u][2:] = [t, last[u][3] + 1, last[u][4] + v]
        else:
            last[u] = [u, t, t, 1, v]
            out.append(last[u])
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("rows", "span"), [(1_000_000, 3000), (60, 3000), (7, 3000), (40, 300), (9, 60)])
def test_equals_plain_sessions(spark, rows, span):
    draw = random.Random(rows)
    made = [(draw.choice([1, 1, 1, 1, 2, 3, 4, None]), draw.choice([draw.randrange(span), None]) if i % 50 == 0 else draw.randrange(span), i, "x", "x", "x", 1) for i in range(500)]
    made += made[:20]
    df = spark.createDataFrame(made, EVENTS)
    got = sessions(df, "u", "t", 10, [F.sum("v").alias("total")], rows)
    assert got.columns == ["u", "start", "stop", "n", "total"]
    assert sorted(map(tuple, got.collect())) == plain(made, 10)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, 5, 2, "x", "x", "x", 1)], EVENTS)
    assert [tuple(r) for r in sessions(df, "u", "t", 10, []).collect()] == [(1, 5, 5, 1)]
    assert sessions(df.limit(0), "u", "t", 10, []).count() == 0


def test_a_stream_gives_the_sessions_of_the_batch_with_late_rows(spark):
    draw = random.Random(4)
    zero = datetime.datetime(2024, 1, 1)
    at = lambda s: zero + datetime.timedelta(seconds=s)
    rows = [(draw.choice([1, 1, 2, 3]), draw.randrange(6000), i) for i in range(300)] + [(None, 5, 1), (1, None, 1)]
    rows.sort(key=lambda r: (r[1] if r[1] is not None else 0) + draw.randrange(400))  # out of order, within the delay
    rows.append((9, 100_000, 0))  # closes the others
    source, out, checkpoint = (shared_path(spark, n) for n in ("events", "sessions", "stream"))
    shape = "u long, t timestamp, v long"
    for k in range(0, len(rows), 60):
        part = [(u, None if t is None else at(t), v) for u, t, v in rows[k : k + 60]]
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        # each call is a restart: state and watermark come from the checkpoint
        made = stream_sessions(stream, "u", "t", 60, 900, [F.sum("v").alias("total")])
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    seconds = lambda t: int((t - zero).total_seconds())
    got = sorted((r.u, seconds(r.start), seconds(r.stop), r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == plain([r for r in rows if r[0] != 9], 60)
    # a row of long ago is left out and changes nothing
    spark.createDataFrame([(1, at(0), 7), (9, at(200_000), 0)], shape).coalesce(1).write.mode("append").parquet(source)
    made = stream_sessions(spark.readStream.schema(shape).parquet(source), "u", "t", 60, 900, [F.sum("v").alias("total")])
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).filter("u = 1").count() == sum(r[0] == 1 for r in got)
