"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); the root is the
    smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until nothing changes; each round is a few joins and aggregations with
    partial sums, so a node with very many neighbours is no task of its own.
    Every round is written to the shared folder, which cuts the lineage. Edges
    from a node to itself are left out; an empty graph gives no rows.
    rows: about how many edges there are, for the first round's files.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name, rows)
    mark = None
    while True:
        # large star: every neighbour above a node moves to the node's minimum
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        # small star: a node and its smaller neighbours move to their minimum
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        now = written(small.filter("a < b").distinct(), name, mark[0] if mark and rows is not None else rows)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a"), F.col("a")).distinct())
