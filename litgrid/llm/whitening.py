"""Whitening of embeddings: principal components of a distributed covariance, and every vector's coordinates along them.

Each pass over the vectors leaves little behind: the first counts lengths, the second sums whole numbers, the third adds up the
products of centred entries, one row for each pair of dimensions, which Spark sums over the tasks. Only that matrix, whose
size the dimension bounds, comes to the driver. There it is brought to tridiagonal form by Householder reflections; Sturm
counts bisect for the leading eigenvalues, inverse iteration with reorthogonalisation inside clusters of near eigenvalues gives
the vectors, and the reflections turn those back. The projection is told to the tasks, and one last pass writes the coordinates.

Entries are fixed-point numbers x = floor(SCALE * c) + OFFSET; sums of them are exact, and centring takes the whole part of the
mean away in whole numbers before anything is rounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.session import ready_checkpoints, ready_workers

SCALE, OFFSET = 1024, 100_000
#: Entries are held to this size, so that sums of squares of a row can be told to fit before they are taken.
LARGEST = 1 << 61
COMPONENTS = 8
#: Vectors of a block that is centred and multiplied at once.
BLOCK = 4096
#: Eigenvalues nearer to each other than this share of the matrix's norm have their vectors made orthogonal to each other.
CLUSTER = 1e-3
#: Rounds of inverse iteration.
ROUNDS = 6
#: Components with less than this share of the largest eigenvalue, times the dimension, are rounding errors.
NOISE = 1e-14
OUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n and sums (whole numbers) of the fit; values, vectors (dimension by components) and trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _fixed(rows: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of this dimension without null or non-finite entries; those in fixed point."""
    size = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
    flat, first = rows.flatten(), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    fine = np.flatnonzero(size == dimension)
    at = (first[fine][:, None] + np.arange(dimension)).ravel()
    c = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)[at].reshape(len(fine), dimension)
    good = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(c[good] * SCALE), -float(LARGEST), float(LARGEST))
    return fine[good], np.clip(scaled.astype(np.int64) + OFFSET, -LARGEST, LARGEST)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, *_fixed(part.column("vector"), dimension)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """x less the whole part of the mean, exactly, and x - S/n in double precision."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    with np.errstate(over="ignore"):
        u = x - whole
    return u, u - rest


def _sum_of_products(rows: DataFrame, dimension: int, project: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The matrix sum(y y') / n of y = project(x), a row of each task for each pair of dimensions summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = 0.0, 0
        for _, _, x in _blocks(batches, dimension):
            y = project(x)
            size = y.shape[1]
            total = total + y.T @ y
        if size:
            a, b = np.tril_indices(size)
            yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "v"])

    found = rows.mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    size = 1 + max((r["a"] for r in found), default=-1)
    out = np.zeros((size, size))
    for r in found:
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["v"] / n
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and those, as (first row, unit vector)."""
    a = np.array(matrix, float)
    d, turns = len(a), []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if not size:
            continue
        v = x / size
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        turns.append((k + 1, v))
    return a.diagonal().copy(), np.array([a[i + 1, i] for i in range(d - 1)]), turns


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each of the values: negative pivots of a Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[k] - at - off[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected between Gershgorin's bounds until no number lies between the ends."""
    d = len(diagonal)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    pad = 1e-300 + 1e-14 * float(np.abs(diagonal).max() + reach.max())
    low, high = np.full(wanted, (diagonal - reach).min() - pad), np.full(wanted, (diagonal + reach).max() + pad)
    index = d - 1 - np.arange(wanted)  # so many eigenvalues are smaller than the one sought
    while True:
        mid = low + (high - low) / 2
        if not ((low < mid) & (mid < high)).any():
            return mid
        under = below(diagonal, off, mid) <= index
        low, high = np.where(under, mid, low), np.where(under, high, mid)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, norm: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) x = b by elimination with row exchanges; pivots that vanish get the size of a rounding error."""
    d, tiny = len(diagonal), norm * np.finfo(float).eps + 1e-300
    u0, u1, u2 = diagonal - value, np.r_[off, 0.0], np.zeros(d)
    swap, factor = np.zeros(d, bool), np.zeros(d)
    low = np.r_[off, 0.0]
    for k in range(d - 1):
        if abs(low[k]) > abs(u0[k]):
            swap[k] = True
            (u0[k], u1[k], u2[k]), (below_, u0_next, u1_next) = (low[k], u0[k + 1], u1[k + 1]), (u0[k], u1[k], u2[k])
            factor[k] = below_ / u0[k]
            u0[k + 1], u1[k + 1] = u0_next - factor[k] * u1[k], u1_next - factor[k] * u2[k]
        else:
            u0[k] = u0[k] if abs(u0[k]) >= tiny else tiny
            factor[k] = low[k] / u0[k]
            u0[k + 1] -= factor[k] * u1[k]
    u0[d - 1] = u0[d - 1] if abs(u0[d - 1]) >= tiny else tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k in range(d - 1):
            if swap[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor[k] * x[k]
        for k in range(d - 1, -1, -1):
            rest = (u1[k] * x[k + 1] if k + 1 < d else 0.0) + (u2[k] * x[k + 2] if k + 2 < d else 0.0)
            x[k] = (x[k] - rest) / u0[k]
            if abs(x[k]) > 1e150:
                x *= 1e-150
        return x

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of the tridiagonal matrix for falling eigenvalues; those of a cluster are orthogonal to each other."""
    d = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])))
    draw, out, first, used = np.random.default_rng(0), np.zeros((d, len(values))), 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues are told apart by a few rounding errors, else each would give the same vector
        used = float(min(value, used - 4 * np.finfo(float).eps * norm)) if j > first else float(value)
        solve, x = _solver(diagonal, off, used, norm), draw.standard_normal(d)
        for _ in range(ROUNDS):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x = x - out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; a vector's largest entry is positive."""
    size = float(np.abs(matrix).max(initial=0.0))
    if not len(matrix) or not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, turns = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, min(wanted, len(matrix)))
    vectors = inverse_iteration(diagonal, off, values)
    for at, v in reversed(turns):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values * size, vectors


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: vector. None if there is no vector without null or non-finite entries, or none with any entry."""
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    most = rows.where(fine & (F.size("vector") > 0)).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not most:
        return None
    d, n = most[0]["d"], most[0]["n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _blocks(batches, d):
            # halves of 32 bits, so that no sum of a block passes 63
            both = [(int(h), int(l)) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([h for h, _ in both], pa.int64()), pa.array([v for _, v in both], pa.int64())], names=["at", "high", "low"])

    wide = "decimal(38,0)"
    added = rows.mapInArrow(sums, "at int, high long, low long").groupBy("at").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    total = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in added.collect()}
    s = tuple(total[k] for k in range(d))
    covariance = _sum_of_products(rows, d, lambda x: _centred(x, n, s)[1], n)
    values, vectors = leading(covariance, components)
    fine = values > NOISE * d * values.max(initial=0.0)
    return Whitening(n, s, values[fine], vectors[:, fine], float(np.trace(covariance)))


def _deviations(u: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The sum over dimensions of (n x - S) ** 2 in whole numbers: n x - S is n u less the rest of S over n."""
    rest = [s % n for s in sums]
    largest = int(np.abs(u).max(initial=0)) + 1
    if u.shape[1] * (n * largest) ** 2 < 1 << 63:
        z = u * n - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = u.astype(object) * n - np.array(rest, object)
    return (z * z).sum(axis=1).tolist()


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """rows: id, vector (an array of floats or doubles); other columns, whatever their names, are not read.

    Returns for each vector and component (from 1, by falling eigenvalue; `components` at most): id, component, n (vectors of
    the fit), deviation (the exact sum over dimensions of (n x - S) ** 2; null where it passes 38 digits), whitened (the
    centred vector along the component, over the root of its eigenvalue), explained (the eigenvalue's share of the trace) and
    identity_error (largest absolute entry of whitened's covariance, taken over all rows, minus the identity). Components are
    unit vectors whose largest entry is positive; of equal eigenvalues any orthogonal ones.

    Vectors that are null or hold null or non-finite entries take no part, nor do empty ones and those not of the most common
    length (of as common ones the larger). Entries beyond LARGEST in fixed point count as that. A null id is kept, repeated
    rows and ids each give their rows. Where all vectors are equal nothing can be whitened, and the result is empty, as for
    an empty table; so are missing those components along which the vectors do not differ. Texts play no part.
    """
    spark = rows.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    model = fit(rows, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    scaled = model.vectors / np.sqrt(model.values)
    unit = _sum_of_products(rows, model.dimension, lambda x: _centred(x, model.n, model.sums)[1] @ scaled, model.n)
    error = float(np.abs(unit - np.eye(len(unit))).max())
    shares, known = model.values / model.trace, spark.sparkContext.broadcast((model, scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scaled = known.value
        k = len(model.values)
        for part, own, x in _blocks(batches, model.dimension):
            u, y = _centred(x, model.n, model.sums)
            total = pa.array([None if v >= 10**38 else v for v in _deviations(u, model.n, model.sums)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(own)), k))
            yield pa.record_batch(
                [
                    part.column("id").take(pa.array(own)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(own) * k, model.n)),
                    total.take(each),
                    pa.array((y @ scaled).ravel()),
                    pa.array(np.tile(shares, len(own))),
                    pa.array(np.full(len(own) * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, OUT)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = whiten(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
