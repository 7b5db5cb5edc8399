"""Embedding whitening: centred covariance added up by Spark, leading components of it, projection of every row.

Eigenvectors come from a Householder tridiagonal form, bisection on Sturm counts and inverse iteration; the driver holds
the d x d covariance of the vectors' d dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT; entries beyond LARGEST have no exact x.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**52
#: Eigenvalues nearer to each other than this share of the largest are one cluster, kept orthogonal among themselves.
CLUSTER = 1e-3
#: Eigenvalues under this share of the trace are zero: their components have no scale.
ZERO = 1e-11
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


class Tridiagonal(NamedTuple):
    """Q' A Q: diagonal, the entries beside it, and the unit vectors of the reflections that make up Q."""

    diagonal: np.ndarray
    beside: np.ndarray
    reflections: list[np.ndarray]

    def back(self, vectors: np.ndarray) -> np.ndarray:
        """Columns in the form's coordinates, in those of A."""
        out = vectors.copy()
        for k in range(len(self.reflections) - 1, -1, -1):
            v = self.reflections[k]
            out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
        return out


def tridiagonal(a: np.ndarray) -> Tridiagonal:
    """Householder: each step clears a column below the entry beside the diagonal, by a reflection from both sides."""
    a = a.copy()
    d, reflections = len(a), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else np.zeros_like(v)
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        if length > 0:
            a[k + 1, k] = -np.copysign(size, a[k + 1, k])
            a[k + 2 :, k] = 0
    return Tridiagonal(np.diag(a).copy(), np.diag(a, -1).copy(), reflections)


def sturm_counts(t: Tridiagonal, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each number: the negative pivots of T - at."""
    least = np.finfo(float).tiny * max(1.0, float((t.beside**2).max(initial=0)))
    below = np.zeros(len(at), int)
    pivot = t.diagonal[0] - at
    for a, b in zip([*t.diagonal[1:], 0.0], [*t.beside, 0.0], strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)  # a pivot of zero counts as negative
        below += pivot < 0
        pivot = a - at - b * b / pivot
    return below


def largest_eigenvalues(t: Tridiagonal, k: int) -> np.ndarray:
    """The k largest, falling: bisection until neighbours in double precision, or far below that of the largest."""
    around = np.abs(np.concatenate([[0], t.beside])) + np.abs(np.concatenate([t.beside, [0]]))
    low, high = (t.diagonal - around).min(), (t.diagonal + around).max()
    margin = 1e-14 * max(abs(low), abs(high)) + np.finfo(float).tiny
    wanted = len(t.diagonal) - 1 - np.arange(k)
    lows, highs = np.full(k, low - margin), np.full(k, high + margin)
    while True:
        middle = (lows + highs) / 2
        open_ = (middle > lows) & (middle < highs) & (highs - lows > 1e-4 * margin)
        if not open_.any():
            return highs
        under = sturm_counts(t, middle) <= wanted
        lows, highs = np.where(open_ & under, middle, lows), np.where(open_ & ~under, middle, highs)


def _factored(t: Tridiagonal, shift: float) -> tuple:
    """Rows of T - shift after elimination with row exchanges (three entries of each), with the multipliers and exchanges."""
    d = len(t.diagonal)
    least = np.finfo(float).eps * max(float(np.abs(t.diagonal).max(initial=0)), float(np.abs(t.beside).max(initial=0)), np.finfo(float).tiny)
    upper = np.zeros((d, 3))
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    row = [t.diagonal[0] - shift, t.beside[0] if d > 1 else 0.0]
    for i in range(d - 1):
        below = (t.beside[i], t.diagonal[i + 1] - shift, t.beside[i + 1] if i + 2 < d else 0.0)
        if abs(below[0]) > abs(row[0]):
            swapped[i] = True
            factor[i] = row[0] / below[0]
            upper[i] = below
            row = [row[1] - factor[i] * below[1], -factor[i] * below[2]]
        else:
            pivot = row[0] if abs(row[0]) > least else least
            factor[i] = below[0] / pivot
            upper[i] = (pivot, row[1], 0.0)
            row = [below[1] - factor[i] * row[1], below[2]]
    upper[d - 1] = (row[0] if abs(row[0]) > least else least, 0.0, 0.0)
    return upper, factor, swapped


def _solved(factored: tuple, b: np.ndarray) -> np.ndarray:
    upper, factor, swapped = factored
    x, d = b.copy(), len(b)
    for i in range(d - 1):
        if swapped[i]:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= factor[i] * x[i]
    for i in range(d - 1, -1, -1):
        x[i] -= upper[i, 1] * (x[i + 1] if i + 1 < d else 0) + upper[i, 2] * (x[i + 2] if i + 2 < d else 0)
        x[i] /= upper[i, 0]
        top = abs(x[i])
        if top > 1e200:  # only the direction matters
            x /= top
    return x


def inverse_iteration(t: Tridiagonal, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of T as columns, for falling eigenvalues. Those of one cluster are made orthogonal to each other in every round."""
    d = len(t.diagonal)
    rng = np.random.default_rng(7)
    out = np.zeros((d, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * abs(values[0]):
            first = k
        factored = _factored(t, value)
        x = rng.standard_normal(d)
        for _ in range(rounds):
            x = _solved(factored, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):  # once more for what the first subtraction left
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns, whose largest entry is positive."""
    top = float(np.abs(a).max(initial=0)) or 1.0
    t = tridiagonal(a / top)
    values = largest_eigenvalues(t, min(k, len(a)))
    vectors = t.back(inverse_iteration(t, values))
    at = np.abs(vectors).argmax(axis=0)
    return values * top, vectors * np.sign(vectors[at, np.arange(len(values))])


def _whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of vectors: which rows have d entries, all of them finite and of an exact x; the x of those rows."""
    fits = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d
    entries = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * entries)
        kept = (np.abs(scaled) < LARGEST).all(axis=1)  # false for NaN
    fits[fits] = kept
    return fits, scaled[kept].astype(np.int64) + SHIFT


def _summed(vectors: DataFrame, d: int, kind: str, part: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """Sums over all rows of part(x of a batch), a matrix of few rows: each task adds its batches up, Spark adds up the tasks by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            more = part(_whole(batch.column(0), d)[1])
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "v": list(total)})

    rows = vectors.select("x").mapInArrow(run, f"i int, v array<{kind}>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(columns)]).alias("v"))
    got = {r["i"]: r["v"] for r in rows.collect()}  # a row for each of the matrix
    return np.array([got[i] for i in range(len(got))])


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of squares of n * x - sums, exact; None where a long cannot hold one."""
    rough = ((float(n) * x.astype(float) - sums.astype(float)) ** 2).sum(axis=1)
    largest = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if largest < 2.0**62 and rough.max(initial=0) < 2.0**62:
        return (((n * x - sums) ** 2).sum(axis=1)).tolist()
    whole = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in whole]


def whitened(embeddings: DataFrame, most: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component up to `most`.

    Each entry c, as double, becomes x = floor(1024 * c) + 100000. The covariance V of all remaining x, divisor n, is added up
    in a second pass from rows less the mean; components are its unit eigenvectors, by falling eigenvalue e, the largest entry positive.
    whitened is the row less the mean, projected and divided by sqrt(e); explained is e / trace(V); identity_error is measured
    in a further pass over the whitened rows. deviation is the exact sum of (n * x - S)^2, null where a long cannot hold it.

    Left out are vectors that are null, empty, hold a null or non-finite entry or one of 2^42 or more (whose x is not exact), and those of another
    length than the commonest of the rest (the longest of equally common ones). A component without variance (all vectors
    equal, fewer rows than components, constant dimensions) cannot be whitened and is left out, so that fewer than `most` may come, or none. Null and repeated
    keys and repeated rows stay, each a row of the fit; other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & (F.abs(F.coalesce(c, F.lit(0.0))) < LARGEST / SCALE) & ~F.isnan(c))
    sizes = rows.where(finite & (F.size("x") > 0)).groupBy(F.size("x").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], WHITENED)
    d = common["d"]
    first = _summed(rows, d, "bigint", lambda x: np.concatenate([[len(x)], x.sum(axis=0)])[None].astype(np.int64), d + 1)[0]
    n, sums = int(first[0]), first[1:]
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(rows, d, "double", products, d) / n
    trace = float(np.trace(covariance))
    if not trace > 0:
        return spark.createDataFrame([], WHITENED)
    values, vectors = leading(covariance, most)
    kept = values > ZERO * trace
    values, vectors = values[kept], vectors[:, kept]
    k = len(values)
    scaled = vectors / np.sqrt(values)

    def own(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    second = _summed(rows, d, "double", own, k) / n
    error = float(np.abs(second[:k] - np.outer(second[k], second[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = _whole(batch.column(1), d)
            if not len(x):
                continue
            ids = pa.array(batch.column(0)).filter(pa.array(fits)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(((x - mean) @ scaled).reshape(-1)),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, WHITENED)
