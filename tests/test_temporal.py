"""The as-of join against a plain one, whatever the ranges."""

import datetime
import random

import pytest

from lodestone.operators.temporal import asof_join, interval_join

T = datetime.datetime(2024, 1, 1)
LEFT, RIGHT = "id long, u long, t timestamp_ntz, key string, found int", "u long, t timestamp_ntz, name string, value double, row int"


def plain(left, right):
    out = []
    for i, u, t, *_ in left:
        near = [(rt, n, v) for ru, rt, n, v, _ in right if ru is not None and rt is not None and ru == u and t is not None and rt <= t]
        best = max(near, default=None)
        out.append((i, u, t, *(best[1:] if best else (None, None))))
    return out


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_equals_a_plain_join(spark, rows):
    draw = random.Random(rows)
    at = lambda: T + datetime.timedelta(seconds=draw.randrange(300))
    user = lambda: draw.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, user(), at(), "k", 1) for i in range(300)] + [(900, 1, None, "k", 1), (901, 9, T, "k", 1), (902, 1, T, "k", 1), (902, 1, T, "k", 1)]
    right = [(user(), at(), draw.choice("abc"), float(i), 2) for i in range(200)] + [(1, None, "z", 1.0, 2)]
    left_df, right_df = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = asof_join(left_df, right_df, "u", "t", ["name", "value"], rows)
    order = lambda rs: sorted(rs, key=str)
    assert order(tuple(r) for r in got.select("id", "u", "t", "name", "value").collect()) == order(plain(left, right))
    assert asof_join(left_df.limit(0), right_df, "u", "t", ["name"]).count() == 0
    assert asof_join(left_df, right_df.limit(0), "u", "t", ["name"]).filter("name is not null").count() == 0


def test_intervals_equal_all_pairs(spark):
    draw = random.Random(5)
    spans = [(i, a, a + draw.choice([0, 1, 2, 3, 7, 8, 9, 100, 1000, -5])) for i, a in enumerate(draw.randrange(-2000, 2000) for _ in range(300))]
    spans += [(900, None, 5), (901, 5, None), (902, -(2**61), 2**61), (903, 10, 20), (903, 10, 20), (904, 0, 2**53 + 1)]
    points = [(i, draw.randrange(-2500, 2500)) for i in range(400)] + [(800, None), (801, 10), (801, 10), (802, 2**53), (803, 2**53 + 1)]
    left, right = spark.createDataFrame(spans, "i long, a long, z long"), spark.createDataFrame(points, "p long, t long")
    got = interval_join(left, right, "a", "z", "t")
    want = [(i, p) for i, a, z in spans for p, t in points if None not in (a, z, t) and a <= t < z]
    assert sorted((r.i, r.p) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert interval_join(left.limit(0), right, "a", "z", "t").count() == interval_join(left, right.limit(0), "a", "z", "t").count() == 0
