"""Whitening of embeddings by polarisation: covariances from squares alone, exact in integers.

With y = n * x - S (the centred vector, times n), the sum of (y_i + y_j)^2 less those of y_i^2 and y_j^2 is twice the sum of y_i * y_j. So one
job aggregates the squares of every dimension and of every sum of two dimensions, and differences of these variances are all covariances.
Squares are summed in 31-bit parts with their place, so no sum rounds or overflows, whatever the number of rows; the exact totals are put
together on the driver (D * (D + 1) / 2 numbers for D dimensions), turned into doubles once, and given to eigh.

The vectors are read four times (sums, squares, the check of the result, the result) and never shuffled: tasks send a few numbers for each pair.

Defined results: vectors that are null or hold null or non-finite entries take no part. Vectors of one length are a list of their own, with n,
sums and components of their own; an empty vector has no components and so no row. Repeated rows, and rows without vec_id, count and come
as they are. An eigenvalue that cannot be told from 0 in double precision has explained, but no whitened value (null), and is left out of
identity_error. A deviation beyond 64 bits is null. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
ROWS = 4096
_BITS = 31
_MASK = (1 << _BITS) - 1
_SAFE = 1 << 61
#: Rows of sums: of the length dim, for i (and j, or -1), value * 2^place.
_SUMS = "dim int, i int, j int, place int, value long"


@dataclass
class Fit:
    """n, sums: of the list; axes: unit eigenvectors as columns; e: their eigenvalues, in units of 4^halvings; explained; sound: whether e is above rounding."""

    n: int
    sums: list[int]
    axes: np.ndarray
    e: np.ndarray
    explained: np.ndarray
    sound: np.ndarray
    halvings: int
    identity_error: float | None = None


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    return rows.where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and vectors of one length, at most ROWS of them."""
    for batch in batches:
        lists = batch.column("v")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offsets)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                yield batch.column("vec_id").take(pa.array(part)), values[offsets[part][:, None] + np.arange(dim)]


def levels(v: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 of every entry, as 64-bit integers or, where an entry is too large for those, as Python's."""
    if np.abs(v).max(initial=0) < 2.0**46:
        return np.floor(v * SCALE).astype(np.int64) + SHIFT
    return np.array([[math.floor(Fraction(c) * SCALE) + SHIFT for c in row] for row in v.tolist()], object).reshape(v.shape)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]
    small = x.dtype != object and max(map(abs, mean), default=0) < _SAFE
    if small:
        d = x - np.array(mean, np.int64)
        small = (int(np.abs(d).max(initial=0)) + 1) * n < _SAFE
    if small:
        return d * n - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _parts(v: np.ndarray, place: int) -> list[tuple[int, np.ndarray]]:
    """Column sums of 64-bit integers, as numbers with places that stay small."""
    return [(place, (v & _MASK).sum(axis=0)), (place + _BITS, (v >> _BITS).sum(axis=0))]


def _big(totals: np.ndarray) -> list[tuple[int, np.ndarray]]:
    out, place, left = [], 0, totals
    while any(abs(t) > _MASK for t in left):
        out.append((place, np.array([t & _MASK for t in left], np.int64)))
        left, place = np.array([t >> _BITS for t in left], object), place + _BITS
    return [*out, (place, left.astype(np.int64))]


def plain_sums(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return _parts(x, 0) if x.dtype != object else _big(x.sum(axis=0))


def square_sums(z: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Column sums of z * z, exactly."""
    if z.dtype == object:
        return _big((z * z).sum(axis=0))
    high, low = z >> _BITS, z & _MASK
    return [*_parts(low * low, 0), *_parts(high * low, _BITS + 1), *_parts(high * high, 2 * _BITS)]


class _Sums:
    """Partial sums of a task by (dim, i, place), one number for each j."""

    def __init__(self):
        self.of: dict[tuple[int, int, int], np.ndarray] = {}

    def add(self, dim: int, i: int, found: list[tuple[int, np.ndarray]]) -> None:
        for place, values in found:
            key = (dim, i, place)
            self.of[key] = self.of[key] + values if key in self.of else values

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (dim, i, place), values in self.of.items():
            full = lambda k, n=len(values): np.full(n, k, np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (full(dim), full(i), np.arange(i + 1, i + 1 + len(values), dtype=np.int32), full(place))), pa.array(values)], ["dim", "i", "j", "place", "value"])


def _totals(sums: DataFrame) -> dict[tuple[int, int, int], int]:
    """(dim, i, j): the exact total. A few numbers for each pair of dimensions."""
    out: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in sums.groupBy("dim", "i", "j", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("t")).toLocalIterator():
        out[r["dim"], r["i"], r["j"]] += int(r["t"]) << r["place"]
    return out


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """S at i = -1, j from 0; n at i = -2, j = -1."""
    sums = _Sums()
    for _, v in _matrices(batches):
        sums.add(v.shape[1], -1, plain_sums(levels(v)))
        sums.add(v.shape[1], -2, [(0, np.array([len(v)]))])
    yield from sums.batches()


def _square_pass(lists) -> Callable:
    """Squares of single dimensions at i = -1, j from 0; of sums of two at (i, j), i < j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for _, v in _matrices(batches):
            dim = v.shape[1]
            y = centred(levels(v), *lists.value[dim])
            sums.add(dim, -1, square_sums(y))
            for i in range(dim - 1):
                sums.add(dim, i, square_sums(y[:, i : i + 1] + y[:, i + 1 :]))
        yield from sums.batches()

    return run


def covariance(n: int, dim: int, squares: Callable[[int, int], int]) -> tuple[np.ndarray, int]:
    """V from the squares of single dimensions (i = -1) and of sums of two: half the difference, over n^3, rounded once. In units of 4^k, k beside it: 0 but for entries near the largest doubles."""
    k = max(0, max(squares(-1, j) for j in range(dim)).bit_length() - 900) // 2
    whole = n**3 << 2 * k
    v = np.empty((dim, dim))
    for j in range(dim):
        v[j, j] = squares(-1, j) / whole
        for i in range(j):
            v[i, j] = v[j, i] = (squares(i, j) - squares(-1, i) - squares(-1, j)) / (2 * whole)
    return v, k


def solve(n: int, sums: list[int], v: np.ndarray, halvings: int, components: int) -> Fit:
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    sound = e > max(float(e.max(initial=0)) * len(v) * np.finfo(float).eps * 4, 0)
    return Fit(n, sums, axes, e, np.where(sound, e, 0) / trace if trace > 0 else np.zeros(len(e)), sound, halvings)


def _project(fit: Fit, y: np.ndarray) -> np.ndarray:
    return np.ldexp((y / fit.n).astype(float), -fit.halvings) @ fit.axes[:, fit.sound] / np.sqrt(fit.e[fit.sound])


def _check_pass(fits) -> Callable:
    """Sums of the products of whitened values, whose mean is 0 as the centred integers add up to 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, v in _matrices(batches):
            fit = fits.value[v.shape[1]]
            w = _project(fit, centred(levels(v), fit.n, fit.sums))
            sums[v.shape[1]] = sums.get(v.shape[1], 0) + w.T @ w
        for dim, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["dim", "i", "j", "value"])

    return run


def _long(y: np.ndarray) -> pa.Array:
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((y * y).sum(axis=1))
    found = (sum(int(c) ** 2 for c in row) for row in y.tolist())
    return pa.array([t if t < 1 << 63 else None for t in found], pa.int64())


def _result_pass(fits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, v in _matrices(batches):
            fit = fits.value[v.shape[1]]
            y = centred(levels(v), fit.n, fit.sums)
            n, c = len(y), len(fit.e)
            white = np.zeros((n, c))
            white[:, fit.sound] = _project(fit, y)
            row = pa.array(np.repeat(np.arange(n), c))
            whole = lambda a, n=n: pa.array(np.tile(a, n))
            yield pa.RecordBatch.from_arrays(
                [keys.take(row), whole(np.arange(1, c + 1, dtype=np.int32)), pa.array(np.full(n * c, fit.n)), _long(y).take(row), pa.array(white.ravel(), mask=np.tile(~fit.sound, n)), whole(fit.explained), pa.array([fit.identity_error], pa.float64()).take(pa.array(np.zeros(n * c, np.int64)))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors among the rows of `usable`."""
    context = rows.sparkSession.sparkContext
    first = _totals(rows.select("vec_id", "v").mapInArrow(_first_sums, _SUMS))
    lists = {dim: (n, [first[dim, -1, j] for j in range(dim)]) for (dim, i, _), n in first.items() if i == -2}
    if not lists:
        return {}
    squares = _totals(rows.mapInArrow(_square_pass(context.broadcast(lists)), _SUMS))
    fits = {dim: solve(n, sums, *covariance(n, dim, lambda i, j, dim=dim: squares[dim, i, j]), components) for dim, (n, sums) in lists.items()}
    off: dict[int, float] = {}
    found = rows.mapInArrow(_check_pass(context.broadcast(fits)), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("t"))
    for r in found.toLocalIterator():
        off[r["dim"]] = max(off.get(r["dim"], 0.0), abs(r["t"] / fits[r["dim"]].n - (r["i"] == r["j"])))
    for dim, f in fits.items():
        f.identity_error = off.get(dim)
    return fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for every usable vector."""
    rows = usable(vectors)
    shared = rows.sparkSession.sparkContext.broadcast(fit(rows, components))
    return rows.mapInArrow(_result_pass(shared), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return whiten(table(spark, sf_dir, "embeddings"))
