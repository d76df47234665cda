"""Whitening of vectors with a covariance found by polarisation, exactly.

Vectors become integers (``floor(scale * c)``); the fit list holds each distinct integer vector once. For every dimension i
and every pair i < j the tasks add up the squares of the centred values and of their pair sums, in integers. A variance is
such a sum over n, and the covariance of a pair follows from three of them: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2.
The matrix is assembled from exact fractions on the driver and goes to ``eigh``.

Centring: the tasks centre by the whole number next to the mean, which keeps the squares small, and the exact rest of the
mean (at most a half) is taken off the sums afterwards, also exactly; so all results equal those of values centred by
the exact mean before multiplying. Squares are added in 64-bit integers where a bound on the block shows that they fit, and in
Python integers otherwise; sums of blocks as decimal(38).

To the driver go D * (D + 1) / 2 sums for vectors of D dimensions, whatever the number of rows; to the tasks the mean and
``components`` vectors of D numbers. The fit list is written once in the shared folder and read in three passes.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part; a null id is kept; repeated
rows each get their rows; vectors of different lengths are fitted apart, each length for itself; entries whose scaled
value does not fit a long are cut to its ends; D below ``components`` gives D rows a vector. A component without variance
(eigenvalue at most D * 2^-50 of the trace: fewer distinct vectors than dimensions) has null for whitened values, and the
identity error leaves it out (null if no component has variance). ``explained`` is null if the trace is 0. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import written

#: Integers of a block that are squared at a time.
BLOCK = 1 << 20
SAFE = 2**62


class Model(NamedTuple):
    """What whitening needs for vectors of one length; ``axes`` and ``values`` by falling eigenvalue, ``values`` 0 where there is no variance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def integers(vec: Column, scale: int) -> Column:
    """array<long> of floor(scale * c); null where an entry is null or not finite, and for null or empty vectors."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top, bottom = F.lit(2**63 - 1), F.lit(-(2**63))
    whole = lambda c: F.when(c * scale >= 2.0**63, top).when(c * scale < -(2.0**63), bottom).otherwise(F.floor(c * scale).cast("long"))
    return F.when((F.size(v) > 0) & fine, F.transform(v, whole))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_length(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Blocks of rows whose vectors have the same length."""
    for batch in batches:
        lists = batch.column(column)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            own = batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))
            for at in range(0, own.num_rows, max(1, BLOCK // d)):
                part = own.slice(at, max(1, BLOCK // d))
                yield d, part, matrix(part.column(column))


def peak(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def column_sums(x: np.ndarray) -> list[int]:
    return (x if peak(x) * len(x) < SAFE else x.astype(object)).sum(0).tolist()


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    if peak(x) + max(map(abs, centre)) < SAFE:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def square_sums(y: np.ndarray) -> Iterator[np.ndarray]:
    """For each dimension i: sums of squares of y_i, then of y_i + y_j for each j > i."""
    top = peak(y)
    if y.dtype == np.int64 and 4 * top * top * len(y) >= SAFE:
        y = y.astype(object)
    y = np.ascontiguousarray(y.T)
    for i in range(len(y)):
        sums = y[i] + y[i:]
        sums[0] = y[i]
        yield (sums * sums).sum(1) if y.dtype == object else np.einsum("ij,ij->i", sums, sums)


def totals(rows: DataFrame, add) -> dict[int, list[int]]:
    """For each length the exact sums of the numbers that ``add`` makes of a block; tasks add up their own blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[int]] = {}
        for d, _, x in by_length(batches, 0):
            got = add(d, x)
            own[d] = [a + b for a, b in zip(own[d], got)] if d in own else got
        for d, sums in own.items():
            for at in range(0, len(sums), 10_000):
                part = sums[at : at + 10_000]
                where = pa.array(range(at, at + len(part)), pa.int64())
                # decimal(38) holds any sum of squares of numbers below 2^59; larger ones are sent in two halves
                low = pa.array([s & (2**60 - 1) for s in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int32()), where, pa.array([str(s >> 60) for s in part], pa.string()), low], names=["d", "at", "high", "low"])

    parts = rows.mapInArrow(run, "d int, at long, high string, low long")
    sums = parts.groupBy("d", "at").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out: dict[int, list[int]] = {}
    for r in sums.orderBy("d", "at").collect():  # numbers of dimensions and pairs, however many rows there are
        out.setdefault(r["d"], []).append((int(r["high"]) << 60) + int(r["low"]))
    return out


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Covariance from sums of squares of y and of pair sums, and the sums ``rest`` of y, all exact until the last division."""
    d = len(rest)
    where = {}
    at = 0
    for i in range(d):
        for j in range(i, d):
            where[i, j] = at
            at += 1

    def spread(i: int, j: int) -> int:
        """n^2 times the variance of y_i + y_j (of y_i for i = j)."""
        s = rest[i] + rest[j] if i != j else rest[i]
        return n * squares[where[i, j]] - s * s

    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(spread(i, i), n * n) if i == j else Fraction(spread(i, j) - spread(i, i) - spread(j, j), 2 * n * n)
            v[i, j] = v[j, i] = float(exact)
    return v


def fit_list(vectors: DataFrame, *, vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each distinct integer vector once, as a table in the shared folder."""
    x = vectors.select(integers(F.col(vec_col), scale).alias("x")).filter(F.col("x").isNotNull())
    return written(x.distinct(), "fit-list")


def fit(distinct: DataFrame, components: int = 4) -> dict[int, Model]:
    """A model for each length of the vectors in a fit list (column x)."""
    counted = totals(distinct, lambda d, x: [len(x), *column_sums(x)])
    centre = {d: [(2 * s + c[0]) // (2 * c[0]) for s in c[1:]] for d, c in counted.items()}

    def squared(d: int, x: np.ndarray) -> list[int]:
        return [int(s) for part in square_sums(centred(x, centre[d])) for s in part.tolist()]

    squares = totals(distinct, squared)
    out = {}
    for d, (n, *sums) in counted.items():
        v = covariance(n, [s - n * c for s, c in zip(sums, centre[d])], squares[d])
        values, axes = np.linalg.eigh(v)
        order, trace = np.argsort(-values, kind="stable")[: min(components, d)], float(np.trace(v))
        values, axes = values[order], axes[:, order]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1.0, 1.0)
        share = values / trace if trace > 0 else np.full(len(values), np.nan)
        out[d] = Model(n, sums, v, axes, np.where(values > d * 2.0**-50 * trace, values, 0.0), share)
    return out


def project(x: np.ndarray, m: Model) -> np.ndarray:
    """Centred rows on the axes, over the root of the eigenvalue; not a number where that is 0."""
    # whole parts are subtracted in integers, so that large means keep the digits of small differences
    whole = [s // m.n for s in m.sums]
    rest = np.array([float(Fraction(s - w * m.n, m.n)) for s, w in zip(m.sums, whole)])
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((centred(x, whole).astype(np.float64) - rest) @ m.axes) / np.where(m.values > 0, np.sqrt(m.values), np.nan)


def deviations(x: np.ndarray, m: Model) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2, exact."""
    top = m.n * peak(x) + max(map(abs, m.sums))
    if top < SAFE and top * top * x.shape[1] < SAFE:
        y = m.n * x - np.array(m.sums, np.int64)
    else:
        y = m.n * x.astype(object) - np.array(m.sums, object)
    return (y * y).sum(1).tolist()


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """For each length the largest entry of the covariance of whitened vectors, over the fit list, minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _, x in by_length(batches, 0):
            w = project(x, models[d])  # centred: its mean is 0 but for rounding
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([(w.T @ w).ravel().tolist()], pa.list_(pa.float64())), pa.array([w.sum(0).tolist()], pa.list_(pa.float64()))], names=["d", "products", "sums"])

    parts = distinct.mapInArrow(run, "d int, products array<double>, sums array<double>")
    add = lambda c: parts.select("d", F.posexplode(c).alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v")).orderBy("d", "at").collect()
    errors: dict[int, float | None] = {}
    products, sums = add("products"), add("sums")
    for d, m in models.items():
        k = len(m.values)
        mean = np.array([r["v"] for r in sums if r["d"] == d]) / m.n
        cov = np.array([r["v"] for r in products if r["d"] == d]).reshape(k, k) / m.n - np.outer(mean, mean)
        real = m.values > 0
        errors[d] = float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max()) if real.any() else None
    return errors


def whiten(vectors: DataFrame, models: dict[int, Model], errors: dict[int, float | None], *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation (decimal(38)), whitened, explained, identity_error: a row for each vector and component."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), integers(F.col(vec_col), scale).alias("x")).filter(F.col("x").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part, x in by_length(batches, 1):
            m = models[d]
            w, rows_, k = project(x, m), len(x), len(m.values)
            each = np.repeat(np.arange(rows_), k)
            far = [str(v) for v in deviations(x, m)]
            nan = lambda a: pa.array(a, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows_), pa.int32()), pa.array([m.n] * (rows_ * k), pa.int64()), pa.array(far, pa.string()).take(pa.array(each)),
                 nan(w.ravel()), nan(np.tile(m.explained, rows_)), pa.array([errors[d]] * (rows_ * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def fit_and_whiten(vectors: DataFrame, components: int = 4, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    distinct = fit_list(vectors, vec_col=vec_col, scale=scale)
    models = fit(distinct, components)
    return whiten(vectors, models, identity_errors(distinct, models), id_col=id_col, vec_col=vec_col, scale=scale)
