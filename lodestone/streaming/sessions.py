"""Sessions of a stream, as its rows come.

The batch form is lodestone.operators.temporal.sessions; both give the same rows
where no row is later than the delay.

Defined cases: rows without a key or a time are in no session; a row that is
more than the delay behind the latest time of the batches before may be left
out; repeated rows count each; a session is given once, when the delay has
passed its end, so the last ones wait for a later row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, by: str, time: str, gap: int, delay: int, told: list[Column]) -> DataFrame:
    """(by, start, stop, n, told) of a stream of events with a timestamp; gap
    and delay are seconds. Its state is the open sessions: one row each, since
    Spark merges the rows of a batch within the tasks before they meet the
    state, where the session's setting for that is on."""
    seen = events.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{delay} seconds")
    # a window ends just before its stop, a session a gap after its last row
    window = F.session_window(time, f"{gap} seconds")
    grouped = seen.groupBy(by, window.alias("window")).agg(F.max(time).alias("stop"), F.count("*").alias("n"), *told)
    return grouped.select(by, F.col("window.start").alias("start"), "stop", "n", *[c for c in grouped.columns if c not in (by, "window", "stop", "n")])
