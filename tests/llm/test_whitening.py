"""Whitening against a plain version in numpy and whole numbers."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, dim int, x string, id int"


def plain(rows, components=16):
    """(vec_id, n, deviation) and the whitened coordinates up to sign, with the
    shares of the trace."""
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = lambda x: [n * a - s for a, s in zip(x, sums)]
    centre = np.array([[d / n for d in dev(x)] for x in fit])
    cov = centre.T @ centre / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, n, sum(d * d for d in dev(x)), np.array([d / n for d in dev(x)]) @ vectors / np.sqrt(values)) for i, x in xs]
    return out, values / np.trace(cov)


def check(got, want, explained):
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert sorted(by_id) == sorted({w[0] for w in want})
    signs = None
    for i, n, deviation, white in want:
        rows = sorted(by_id[i], key=lambda r: r.component)
        rows = rows[: len(white)] if len({r.whitened for r in rows}) == len(white) else sorted(set(rows), key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(white) + 1))
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        y = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.sign(y * white)
        np.testing.assert_allclose(y * signs, white, rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose([r.explained for r in rows], explained, rtol=1e-9)
        assert all(r.identity_error <= 1e-9 for r in rows)


@pytest.mark.parametrize("dim, tile, scale", [(20, 8, 0.2), (16, 16, 1.0), (3, 2, 3e3), (40, 7, 3.0)])
def test_equals_numpy(spark, dim, tile, scale, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 37)
    draw = np.random.default_rng(dim)
    base = draw.standard_normal((300, dim)) * scale * (1 + np.arange(dim))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)
    q = whitening.quantised(df)
    check(whitening.whiten(q, whitening.fit_whitening(q, tile=tile)).collect(), *plain(rows))


def test_odd_rows(spark):
    draw = random.Random(1)
    good = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [math.nan, 0.0, 0.0, 0.0]), (53, [math.inf, 0.0, 0.0, 0.0]), (54, []), (55, [1e300, 0.0, 0.0, 0.0])]
    zero, lone = [(60, [0.0, 0.0, 0.0, 0.0])], [(70, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in good + bad + zero + lone], SCHEMA)
    q = whitening.quantised(df)
    fits = whitening.fit_whitening(q)
    check(whitening.whiten(q, fits).collect(), *plain(good + zero))
    assert fits[2].n == 1 and fits[2].weights.shape == (2, 0)  # one vector has no variance
    none = whitening.quantised(df.limit(0))
    assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0
    ids = whitening.quantised(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [2.0, 2.5])], "vec_id long, embedding array<double>"))
    assert sorted(str(r.vec_id) for r in whitening.whiten(ids, whitening.fit_whitening(ids)).collect()) == ["1", "None", "None"]


def test_deviations_beyond_a_long_are_null_and_others_exact(spark):
    rows = [(i, [float(i) * 2.0**30, float(i % 3)]) for i in range(40)]
    q = whitening.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = {i: d for i, _, d, _ in plain(rows)[0]}
    got = {r.vec_id: r.deviation for r in whitening.whiten(q, whitening.fit_whitening(q)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()


def test_too_many_columns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_COLUMNS", 3)
    q = whitening.quantised(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        whitening.fit_whitening(q)


def test_query(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = whitening.op11_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows)
    check(got, *plain(rows))
