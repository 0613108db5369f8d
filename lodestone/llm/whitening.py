"""Whitening of embeddings by a tiled covariance.

Vectors become whole numbers, x = floor(64 c) + 1,000,000 for a component c, and
the fit list is each distinct x once. It is cut into row blocks, and each of
these into column blocks of TILE dimensions. Pairs of column blocks are the
tiles of the covariance: the blocks are copied to the tiles they belong to, meet
there by row block, are centred by exact sums and multiplied, and the products
are summed per tile, those of a bundle of row blocks first. The tiles of a
matrix are assembled and decomposed in one task, whose size follows the square
of the dimensions and not the rows. The driver sees sums and components alone.

A vector that a third of all rows repeat is one row of the fit list, as partial
aggregation drops repeats before the shuffle; all else is dealt by row blocks.

Defined cases: rows whose vector is null or empty, or holds a null, a component
that is not finite, or one beyond 2 ** 45 in size take no part; zero vectors do;
vectors of different lengths are fitted apart; repeated rows and null ids are
given each; components without variance (fewer distinct vectors than dimensions,
or constant ones) are left out, so a fit of one vector gives no rows; deviations
beyond a long are null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions of a column block.
TILE = 32
#: Rows of a row block, and row blocks whose products are summed in one task.
ROWS, BUNDLE = 8192, 16
#: Components beyond this size take no part.
LARGEST = 2.0**45
#: Columns of all lengths of vectors together; the covariance is dense in them.
MAX_COLUMNS = 1 << 16
WIDTHS = (np.dtype("i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


class Fit(NamedTuple):
    """n and sums are exact, sums of x - SHIFT; the columns of `weights` are
    components over the roots of their variances."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    error: float


def _pack(q: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all."""
    most = max(int(q.max()), -int(q.min()) - 1)
    width = next(w for w in WIDTHS if most <= np.iinfo(w).max)
    return bytes([width.itemsize]) + q.astype(width).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, WIDTHS[packed[0].bit_length() - 1], offset=1).astype(np.int64)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, q) of the packed vectors of a batch, ROWS at a time."""
    dims, packed = np.array(batch.column("dim"), np.int64), batch.column("x").to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for k in range(0, len(at), ROWS):
            rows = at[k : k + ROWS]
            yield int(dim), rows, np.stack([_unpack(packed[i]) for i in rows])


def centred(q: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact; Python numbers where a long is too small."""
    most = n * max(int(q.max(initial=0)), -int(q.min(initial=0))) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 2**62 else object
    return q.astype(kind) * n - np.array(sums, kind)


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, x) of the rows that take part; x - SHIFT is packed."""
    kind = vectors.schema[id].dataType.simpleString()
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("v is not null and size(v) > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False)  # a null component is nan
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            wrong = np.append(0, np.cumsum(~(np.abs(values) <= LARGEST)))
            keep = np.flatnonzero(wrong[ends[1:]] == wrong[ends[:-1]])
            q = np.floor(np.where(np.abs(values) <= LARGEST, values, 0.0) * SCALE).astype(np.int64)
            x = [_pack(q[ends[i] : ends[i + 1]]) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), pa.array((ends[1:] - ends[:-1])[keep].astype(np.int32)), pa.array(x, pa.binary())], names=["id", "dim", "x"])

    return rows.mapInArrow(pack, f"id {kind}, dim int, x binary")


def column_blocks(fit: DataFrame, tile: int = TILE) -> DataFrame:
    """(dim, block, col, n, sums, data): the column blocks of each row block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, rows, q in _by_dim(batch):
                parts = [q[:, k : k + tile] for k in range(0, dim, tile)]
                made = [(dim, block, k, len(rows), [int(s) for s in p.sum(axis=0, dtype=object)], _pack(p.ravel())) for k, p in enumerate(parts)]
                block += 1
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["dim", "block", "col", "n", "sums", "data"])

    return fit.select("dim", "x").mapInArrow(cut, "dim int, block bigint, col int, n bigint, sums array<bigint>, data binary")


def _sums(blocks: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and exact sums by length: a number for each column, MAX_COLUMNS at most."""
    whole = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    each = blocks.select("dim", "col", "n", F.posexplode("sums").alias("pos", "s")).groupBy("dim", "col", "pos").agg(F.sum("n").alias("n"), whole)
    rows = each.limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"the vectors' lengths add up to more than {MAX_COLUMNS}")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.dim, r.col, r.pos)):
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def covariance_tiles(blocks: DataFrame, sums: dict[int, tuple[int, list[int]]], tile: int = TILE) -> DataFrame:
    """(dim, i, j, r, c, v): entries of the tiles i <= j, times n."""
    last = F.floor((F.col("dim") - 1) / tile).cast("int")
    both = F.concat(
        F.transform(F.sequence(F.col("col"), last), lambda j: F.struct(F.col("col").alias("i"), j.alias("j"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("col")), lambda i: i < F.col("col")), lambda i: F.struct(i.alias("i"), F.col("col").alias("j"))),
    )
    bundle = F.expr(f"shiftright(block, 32) * 4294967296 + (block & 4294967295) div {BUNDLE}")
    dealt = blocks.select("dim", "block", "col", "data", bundle.alias("bundle"), F.explode(both).alias("pair")).select("dim", "pair.i", "pair.j", "bundle", "block", "col", "data")

    def multiply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, i, j, _ = (k.as_py() for k in key)
        n, of = sums[dim]
        met: dict[int, dict[int, bytes]] = {}
        for row in rows.select(["block", "col", "data"]).to_pylist():
            met.setdefault(row["block"], {})[row["col"]] = row["data"]
        total = 0.0
        for part in met.values():
            left, right = (centred(_unpack(part[k]).reshape(-1, min(tile, dim - k * tile)), n, of[k * tile : (k + 1) * tile]).astype(np.float64) / n for k in (i, j))
            total = total + left.T @ right
        r, c = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        head = [pa.array(np.full(total.size, k, np.int32)) for k in (dim, i, j)]
        return pa.Table.from_arrays([*head, pa.array(r), pa.array(c), pa.array(total.ravel())], names=["dim", "i", "j", "r", "c", "v"])

    products = dealt.groupBy("dim", "i", "j", "bundle").applyInArrow(multiply, "dim int, i int, j int, r int, c int, v double")
    return products.groupBy("dim", "i", "j", "r", "c").agg(F.sum("v").alias("v"))


def eigen(tiles: DataFrame, sums: dict[int, tuple[int, list[int]]], components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """(dim, values, vectors, trace): the largest eigenvalues of each length's
    covariance and their unit vectors. A group is one matrix."""

    def decompose(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        i, j, r, c = (rows[k].to_numpy().astype(np.int64) for k in "ijrc")
        v, cov = rows["v"].to_numpy() / sums[dim][0], np.zeros((dim, dim))
        cov[i * tile + r, j * tile + c] = v
        cov[j * tile + c, i * tile + r] = v
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        # what rounding leaves of a variance of zero is none
        many = int((values[:components] > max(values[0], 0.0) * dim * 1e-14).sum()) if values[0] > 0 else 0
        made = {"dim": [dim], "values": [values[:many].tobytes()], "vectors": [np.ascontiguousarray(vectors[:, :many]).tobytes()], "trace": [float(np.trace(cov))]}
        return pa.Table.from_pydict(made, pa.schema([("dim", pa.int32()), ("values", pa.binary()), ("vectors", pa.binary()), ("trace", pa.float64())]))

    return tiles.groupBy("dim").applyInArrow(decompose, "dim int, values binary, vectors binary, trace double")


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest absolute entry of the whitened fit list's covariance minus
    the identity, by length."""

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, q in _by_dim(batch):
                y = centred(q, fits[dim].n, fits[dim].sums).astype(np.float64) / fits[dim].n @ fits[dim].weights
                y = np.column_stack([y, np.ones(len(y))])  # the last row and column sum y
                totals[dim] = totals.get(dim, 0.0) + y.T @ y
        for dim, t in totals.items():
            r, c = np.indices(t.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, dim, np.int32)), pa.array(r), pa.array(c), pa.array(t.ravel())], names=["dim", "r", "c", "v"])

    found = fit.mapInArrow(square, "dim int, r int, c int, v double").groupBy("dim", "r", "c").agg(F.sum("v").alias("v")).collect()
    out = {}
    for dim, of in fits.items():
        k = of.weights.shape[1]
        whole = np.zeros((k + 1, k + 1))
        for r in found:
            if r.dim == dim:
                whole[r.r, r.c] = r.v / of.n
        cov = whole[:k, :k] - np.outer(whole[:k, k], whole[:k, k])
        out[dim] = float(np.abs(cov - np.eye(k)).max(initial=0.0))
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> dict[int, Fit]:
    """The whitening of each length of vectors, from quantised rows."""
    fit = written(rows.select("dim", "x").distinct(), "fit")
    blocks = written(column_blocks(fit, tile), "blocks")
    sums = _sums(blocks)
    fits = {}
    for r in eigen(covariance_tiles(blocks, sums, tile), sums, components, tile).collect():  # a row for each length
        values = np.frombuffer(r["values"])
        fits[r.dim] = Fit(*sums[r.dim], np.frombuffer(r.vectors).reshape(r.dim, -1) / np.sqrt(values), values / r.trace if r.trace else values, 0.0)
    errors = identity_errors(fit, fits) if fits else {}
    return {dim: f._replace(error=errors[dim]) for dim, f in fits.items()}


def whiten(rows: DataFrame, fits: dict[int, Fit], id: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of
    each quantised row and component."""
    kind = rows.schema["id"].dataType.simpleString()
    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, q in _by_dim(batch):
                n, sums, weights, explained, error = fits[dim]
                k, m = weights.shape[1], centred(q, n, sums)
                most = int(abs(m).max(initial=0))
                square = m if m.dtype == object or most**2 * dim < 2**63 else m.astype(object)
                far = [s if s < 2**63 else None for s in (square * square).sum(axis=1).tolist()]
                y = m.astype(np.float64) / n @ weights
                each = pa.array(np.repeat(np.arange(len(at)), k))
                total = len(at) * k
                arrays = [batch.column("id").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(total, n, np.int64))]
                arrays += [pa.array(far, pa.int64()).take(each), pa.array(y.ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(total, error))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(project, f"`{id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = written(quantised(vectors), "quantised")
    return whiten(rows, fit_whitening(rows))
