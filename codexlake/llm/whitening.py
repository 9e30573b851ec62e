"""Whitening of integer vectors: covariance summed over all tasks, leading eigenvectors, projection with the broadcast model.

Sums over the vectors are made in the tasks; the driver gets as many rows as there are dimensions, and solves the
symmetric problem of that size: Householder reflections to a tridiagonal matrix, bisection by Sturm counts for the
leading eigenvalues, inverse iteration for their vectors, orthogonal within clusters of close eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import stored
from codexlake.llm.common import only, prepare, table

SCALE = 256
COMPONENTS = 4
#: Eigenvalues closer than this share of the largest are a cluster; inverse iterations of a vector.
CLUSTER, ITERATIONS = 1e-3, 6
#: Sums of integers stay below this.
_MOST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n vectors of sums S; eigenvalues falling, components as rows of unit length, and the share of each in the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry c as double. Rows whose vector is null or holds null or non-finite entries are dropped.

    An empty vector stays. Entries beyond the 64-bit range are held at its end.
    """
    v = only(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.where(F.col("v").isNotNull() & ~odd).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def rows_of(column: pa.Array, dims: int, dtype) -> np.ndarray:
    """A list column as a matrix of `dims` columns; shorter vectors have zeros at their end."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _summed(batches: Iterator[pa.RecordBatch], dims: int, dtype, part: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task's rows x add up to: one (i, values) for each row of the matrix that `part` gives."""
    total = None
    for batch in batches:
        if len(batch):
            found = part(rows_of(batch.column(0), dims, dtype))
            total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "v"])


def totals(x: DataFrame, dims: int) -> list[int]:
    """Exact sums of each dimension of the integer vectors in column x."""

    def part(m: np.ndarray) -> np.ndarray:
        if len(m) and int(np.abs(m.astype(float)).max(initial=0)) > _MOST // max(1, len(m)):
            raise OverflowError("entries of the integer vectors are too large to add up in 64 bits")
        return m.sum(0)[:, None]

    found = x.mapInArrow(lambda b: _summed(b, dims, np.int64, part), "i int, v array<bigint>").groupBy("i").agg(F.sum(F.col("v")[0].cast("decimal(38,0)")).alias("s"))
    by = {r.i: int(r.s) for r in found.collect()}
    return [by.get(i, 0) for i in range(dims)]


def covariance(x: DataFrame, dims: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Mean of (x - mean)(x - mean)^T over column x; every row is centred before it is multiplied."""

    def part(m: np.ndarray) -> np.ndarray:
        m = m - mean
        return m.T @ m

    found = x.mapInArrow(lambda b: _summed(b, dims, np.float64, part), "i int, v array<double>")
    # one row for each entry and task, added up in the tasks that get them
    added = found.select("i", F.posexplode("v").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((dims, dims))
    for r in added.collect():
        out[r.i, r.j] = r.s / n
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with a = q t q^T, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0 or not np.abs(v[1:]).any():
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each value of `at`."""
    tiny = np.finfo(float).tiny ** 0.5
    count, pivot = np.zeros(len(at), int), np.ones(len(at))
    for k in range(len(d)):
        pivot = d[k] - at - (e[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, each halved in to the last bit."""
    radius = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    k = np.arange(1, min(most, len(d)) + 1)
    low, high = np.full(len(k), (d - radius).min()), np.full(len(k), (d + radius).max())
    for _ in range(2000):
        mid = (low + high) / 2
        if not ((mid > low) & (mid < high)).any():
            break
        # the k-th largest is at or above mid if no more than n - k are below it
        up = below(d, e, mid) <= len(d) - k
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return low


def solve(d: np.ndarray, e: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """The tridiagonal system with diagonal d, by elimination with row exchanges; pivots of nearly zero count as `tiny`."""
    n = len(d)
    u, w, z, b = d.astype(float).copy(), np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        under, diag, right = e[k], u[k + 1], w[k + 1]
        if abs(under) > abs(u[k]):
            u[k], w[k], z[k], under, diag, right = under, diag, right, u[k], w[k], 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        pivot = u[k] if abs(u[k]) > tiny else tiny
        u[k] = pivot
        f = under / pivot
        u[k + 1], w[k + 1] = diag - f * w[k], right - f * z[k]
        b[k + 1] -= f * b[k]
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        pivot = u[k] if abs(u[k]) > tiny else tiny
        x[k] = (b[k] - w[k] * x[k + 1] - z[k] * x[k + 2]) / pivot
    return x[:n]


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as rows, by inverse iteration; those of a cluster are made orthogonal in each step."""
    size = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    rng, out = np.random.default_rng(12), []
    for k, value in enumerate(values):
        near = [v for v, other in zip(out, values, strict=False) if abs(other - value) <= CLUSTER * size]
        # equal eigenvalues are moved apart a little, as their systems would have one solution
        shift = value - len(near) * np.finfo(float).eps * size
        x = rng.standard_normal(len(d))
        for _ in range(ITERATIONS):
            for _ in range(2):
                for v in near:
                    x = x - (x @ v) * v
            x /= np.linalg.norm(x)
            x = solve(d - shift, e, x, np.finfo(float).eps * size)
            x /= np.abs(x).max()
        for _ in range(2):
            for v in near:
                x = x - (x @ v) * v
            x /= np.linalg.norm(x)
        out.append(x)
    return np.array(out).reshape(len(values), len(d))


def leading(a: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows; those within rounding of zero are left out."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(a)
    values = leading_values(d, e, most)
    values = values[values > len(a) * np.finfo(float).eps * max(np.trace(a), 0)]
    vectors = leading_vectors(d, e, values) @ q.T
    return values, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def projected(m: np.ndarray, model: Whitening) -> np.ndarray:
    """Integer rows centred, projected and divided by the deviation of each component."""
    return (m - np.array([s / model.n for s in model.sums])) @ model.components.T / np.sqrt(model.values)


def fit_whitening(x: DataFrame, most: int = COMPONENTS) -> Whitening:
    """The model of the distinct vectors in column x, each counted once. No vectors, or equal ones only, give no components."""
    dims = x.agg(F.max(F.size("x"))).first()[0] or 0
    # equal once the shorter ones have their zeros
    fit = stored(x.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), dims - F.size("x"))).alias("x")).distinct(), "fit")
    n = fit.count()
    sums = totals(fit, dims)
    v = covariance(fit, dims, n, np.array([s / n for s in sums])) if n else np.zeros((0, 0))
    values, components = leading(v, most)
    model = Whitening(n, sums, values, components, values / np.trace(v) if len(values) else values, 0.0)
    if not len(values):
        return model
    k = len(values)
    white = fit.mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array(list(projected(rows_of(r.column(0), dims, np.int64), model)), pa.list_(pa.float64()))], names=["x"]) for r in b), "x array<double>")
    means = white.select(F.posexplode("x").alias("i", "s")).groupBy("i").agg(F.avg("s").alias("s"))
    centre = np.array([r.s for r in means.orderBy("i").collect()])
    error = float(np.abs(covariance(white, k, n, centre) - np.eye(k)).max())
    return Whitening(n, sums, values, components, model.explained, error)


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n * x - S) ** 2 over the dimensions; an error if one is beyond 64 bits."""
    reach = n * int(np.abs(m.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if reach * reach * max(1, len(sums)) < _MOST:
        return ((n * m - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    out = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in m]
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation is beyond 64 bits")
    return out


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; every other row stays, repeats and null
    ids too. Equal integer vectors count once in the fit. A shorter vector has zeros in the dimensions that it lacks.
    There are fewer components where the covariance has fewer positive eigenvalues: none, and so no rows, for an empty
    table or if all vectors are equal. Other columns are not looked at.
    """
    prepare(vectors.sparkSession)
    rows = integer_vectors(vectors)
    model = fit_whitening(rows, most)
    k, dims = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k or not len(b):
                continue
            m = rows_of(b.column(1), dims, np.int64)
            each, of = np.repeat(np.arange(len(b)), k), np.tile(np.arange(k), len(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(of + 1, pa.int32()), pa.array(np.full(len(each), model.n)), pa.array(deviations(m, model.n, model.sums), pa.int64()).take(pa.array(each)),
                 pa.array(projected(m, model).ravel()), pa.array(model.explained[of]), pa.array(np.full(len(each), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all `embeddings`. See `whitened`."""
    return whitened(table(spark, sf_dir, "embeddings"))
