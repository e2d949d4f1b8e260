"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of directions Q goes through a polynomial recurrence of
distributed products XᵀXQ over centred vectors, which damps all directions whose eigenvalues lie between
the bounds of the unwanted spectrum; QR and Rayleigh-Ritz then turn the block into approximate
eigenvectors, until the residuals of the wanted ones certify them. Distinct vectors are packed into
binary blocks once, so that each product is a scan and a matrix product per block; the driver holds
matrices of dimension x block only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import written

COMPONENTS = 4
GUARDS = 28
DEGREE = 8
BOUND_STEPS = 10
ROUNDS = 60
SCALE = 256
CERTIFIED = 1e-9
SEED = 20_240_229
BLOCK_VALUES = 1 << 18


class Whitener(NamedTuple):
    """Sums of the fit list, its leading components as columns, their eigenvalues, the trace, and the relative residual that certifies them."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float


def quantised(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the usable vectors of a column of lists, by length: x = floor(scale * c) as int64.

    A null or empty vector is not usable, nor one with a null, non-finite or too large entry for a long.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        for begin in range(0, len(rows), max(1, BLOCK_VALUES // size)):
            some = rows[begin: begin + max(1, BLOCK_VALUES // size)]
            flat = pc.list_flatten(column.take(pa.array(some))).cast(pa.float64())
            values = np.floor(scale * pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(some), size))
            with np.errstate(invalid="ignore"):
                usable = (np.abs(values) < 2.0 ** 62).all(axis=1)
            yield some[usable], values[usable].astype(np.int64)


def _narrowed(x: np.ndarray) -> Iterator[bytes]:
    """Each vector as bytes of the narrowest of three integer types, which its values alone decide, after the type's size."""
    most = np.abs(x).max(axis=1)
    for own, size in zip(x, np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)).tolist()):
        yield bytes([size]) + own.astype(f"<i{size}").tobytes()


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """(d, data) blocks of distinct vectors of d entries, int64 row after row; every distinct vector is in one block, once."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(_narrowed(x)), pa.binary())], names=["x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def block(d: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b"".join(held.pop(d))], pa.binary())], names=["d", "data"])

        for batch in batches:
            for key in batch.column(0):
                raw = key.as_py()
                x = np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype("<i8")
                held.setdefault(len(x), []).append(x.tobytes())
                if len(held[len(x)]) * len(x) >= BLOCK_VALUES:
                    yield block(len(x))
        for d in list(held):
            yield block(d)

    distinct = vectors.select(column).mapInArrow(keys, "x binary").distinct()
    return written(distinct.mapInArrow(packed, "d int, data binary"), "whitening-blocks")


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column("data"):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d)


def sums(blocks: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Exact sums of the entries per dimension, and of all squares."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, d):
            # A block has little more than BLOCK_VALUES entries: up to 2**20 each, the sums fit a long; larger ones are added one by one.
            small = np.abs(x).max() < 1 << 20
            squares = int(np.einsum("ij,ij->", x, x)) if small else sum(v * v for v in x.ravel().tolist())
            entries = x.sum(axis=0).tolist() if small else [sum(c) for c in x.T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, entries)), pa.array([str(squares)] + ["0"] * (d - 1))], names=["at", "s", "q"])

    summed = blocks.mapInArrow(partial, "at int, s string, q string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))
    found = sorted(summed.collect())
    return np.array([int(r["s"]) for r in found], dtype=object), sum(int(r["q"]) for r in found)


def products(blocks: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V q for the covariance V of the fit list: one pass of centred XᵀXq, summed over the blocks of each task and then by Spark."""
    d, width = q.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for x in _matrices(batches, d):
            centred = x - mean
            total += centred.T @ (centred @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(d * width), pa.int64()), pa.array(total.ravel())], names=["at", "v"])

    summed = blocks.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(d * width)
    for at, v in summed.collect():
        out[at] = v
    return out.reshape(d, width) / n


def _lower_bound(product, d: int, rng: np.random.Generator, steps: int) -> float:
    """A bound below the spectrum: the least Ritz value of a short Lanczos run, less its residual, and never under 0."""
    q, before, beta, diagonal, beside = rng.standard_normal(d), np.zeros(d), 0.0, [], []
    q /= np.linalg.norm(q)
    kept = [q]
    for _ in range(min(steps, d)):
        w = product(q[:, None])[:, 0] - beta * before
        diagonal.append(float(w @ q))
        w -= diagonal[-1] * q
        basis = np.array(kept)
        w -= basis.T @ (basis @ w)
        beta = float(np.linalg.norm(w))
        beside.append(beta)
        if beta <= 1e-12 * max(1e-300, abs(diagonal[0])):
            break
        before, q = q, w / beta
        kept.append(q)
    m = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: m - 1], 1) + np.diag(beside[: m - 1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def _filtered(product, q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V on [low, cut], scaled to 1 at top, times q: one product a degree."""
    half, centre = max((cut - low) / 2, 1e-300), (cut + low) / 2
    first = half / (top - centre)
    sigma, before = first, q
    now = (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1.0 / (2.0 / first - sigma)
        before, now = now, 2.0 * (after / half) * (product(now) - centre * now) - sigma * after * before
        sigma = after
    return now


def components(product, d: int, wanted: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvectors of a symmetric positive operator, their eigenvalues, and the largest residual over the largest eigenvalue.

    Goes on until the residuals reach the floor of double precision: no smaller than before, and below CERTIFIED.
    """
    rng = np.random.default_rng(SEED)
    width = min(d, wanted + guards)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    low = _lower_bound(product, d, rng, BOUND_STEPS) if width < d else 0.0
    least = np.inf
    for _ in range(rounds):
        image = product(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top, some = float(values[0]), min(wanted, d)
        if top <= 0:
            return q[:, :0], values[:0], 0.0
        residual = float(np.linalg.norm(image[:, :some] - q[:, :some] * values[:some], axis=0).max()) / top
        if residual <= 1e-15 or residual < CERTIFIED and residual > least / 2:
            break
        least = min(least, residual)
        if width < d:
            q = np.linalg.qr(_filtered(product, q, min(low, float(values[-1]) * 0.999), float(values[-1]), top, degree))[0]
        else:
            q = np.linalg.qr(q)[0]
    if residual > CERTIFIED:
        raise RuntimeError(f"residual {residual} after {rounds} rounds")
    return q[:, :some], values[:some], residual


def fit(vectors: DataFrame, column: str, wanted: int = COMPONENTS) -> tuple[Whitener | None, DataFrame]:
    """The whitener of the distinct vectors, and their blocks. None where no vector is usable.

    The dimension is the length that most distinct vectors have, the larger one of equals. Directions whose eigenvalue is 0 to
    double precision are no components.
    """
    blocks = fit_list(vectors, column)
    sizes = blocks.groupBy("d").agg(F.sum((F.octet_length("data") / 8).cast("long")).alias("values"))
    chosen = sizes.select("d", (F.col("values") / F.col("d")).cast("long").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if chosen is None:
        return None, blocks
    d, n = chosen
    own = blocks.filter(F.col("d") == d)
    total, squares = sums(own, d)
    mean = np.array([s / n for s in total])
    trace = (n * squares - sum(s * s for s in total)) / (n * n)
    q, e, residual = components(lambda q: products(own, n, mean, q), d, wanted)
    kept = e > d * np.finfo(float).eps * max(trace, 1e-300)
    return Whitener(n, total, q[:, kept], e[kept], trace, residual), own


def deviations(x: np.ndarray, fitted: Whitener) -> list[int]:
    """Sum over dimensions of (n*x - S)**2 for each row, exact."""
    most = int(np.abs(x).max()) if x.size else 0
    small = most < 1 << 20 and most * sum(abs(int(s)) for s in fitted.sums) < 1 << 62
    squares = np.einsum("ij,ij->i", x, x).tolist() if small else [sum(v * v for v in r) for r in x.tolist()]
    across = (x @ fitted.sums.astype(np.int64)).tolist() if small else [sum(v * int(s) for v, s in zip(r, fitted.sums)) for r in x.tolist()]
    own = sum(int(s) ** 2 for s in fitted.sums)
    return [fitted.n ** 2 * a - 2 * fitted.n * b + own for a, b in zip(squares, across)]


def projected(x: np.ndarray, fitted: Whitener) -> np.ndarray:
    mean = np.array([s / fitted.n for s in fitted.sums])
    return (x - mean) @ (fitted.directions / np.sqrt(fitted.eigenvalues))


def identity_error(blocks: DataFrame, fitted: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, from Spark's centred covariances."""
    d, k = fitted.directions.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, d):
            w = projected(x, fitted)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = blocks.mapInArrow(rows, ", ".join(f"w{i} double" for i in range(k))).agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Usable vectors hold finite entries only, none null, of a size whose 256-fold fits a long, and have the table's dimension: the
    length of most distinct vectors, the larger one of equals. Others are dropped. n counts the distinct vectors. Components
    with an eigenvalue of 0 are not given, so equal vectors throughout, one vector, or an empty table give no rows.
    A deviation beyond a long is null. Repeated rows are repeated in the result. Other columns are not read.
    """
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted, blocks = fit(vectors, column, wanted)
    if fitted is None or not len(fitted.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(blocks, fitted)
    d, k = fitted.directions.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in quantised(batch.column(1)):
                if x.shape[1] != d or not len(x):
                    continue
                deviation = [v if v < 1 << 63 else None for v in deviations(x, fitted)]
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(projected(x, fitted).ravel()),
                    pa.array(np.tile(fitted.eigenvalues / fitted.trace, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", column).mapInArrow(rows, schema)
