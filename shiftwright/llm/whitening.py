"""Whitening on the leading components of a covariance, which contour integration finds.

Sums and second moments are exact: components are whole numbers, and each is taken relative to its rounded mean before
it is multiplied, so that the sums of tasks may be added in any order. What comes to the driver is one number for each
pair of dimensions. There the FEAST method finds the eigenvectors: for an interval, the integral of (zI - V)^-1 Y around
a circle over it, by quadrature with complex shifted solves, leaves only the interval's part of Y; a Rayleigh-Ritz step
takes eigenpairs from it, and this repeats until they are exact. Intervals are cut by the inertia of V - aI, the number
of its positive pivots, which says how many eigenvalues lie above a; each interval must yield as many as that.
Projections are computed in the tasks and written to the shared folder, and their covariance is measured from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.session import cut

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
# Larger components count as these.
LIMIT = 1 << 42
# Nodes of the quadrature on the half circle, eigenvalues that an interval may hold, rounds of an interval.
NODES, INTERVAL, ROUNDS = 12, 4, 64
# Relative to the norm of the matrix: residuals of eigenpairs, widths below which intervals are not cut any more.
RESIDUAL, NARROW = 2e-15, 1e-12


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: by symmetric elimination with 1x1 and 2x2 pivots."""
    a, count = matrix.copy(), 0
    ratio = (1 + 17**0.5) / 8
    while n := len(a):
        size = np.abs(a)
        diagonal = int(np.diag(size).argmax())
        row, column = divmod(int(size.argmax()), n)
        if not size[row, column]:
            return count
        if size[diagonal, diagonal] >= ratio * size[row, column]:
            pivot = [diagonal]
            count += a[diagonal, diagonal] > 0
        else:
            pivot = [row, column]
            block = a[np.ix_(pivot, pivot)]
            # A negative determinant has one positive eigenvalue; else both have the sign of the trace.
            count += 1 if np.linalg.det(block) < 0 else 2 * int(np.trace(block) > 0)
        rest = np.setdiff1d(np.arange(n), pivot)
        cross = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(a[np.ix_(pivot, pivot)], cross.T)
        a = (a + a.T) / 2
    return count


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``."""
    return positive_pivots(matrix - shift * np.eye(len(matrix)))


def intervals(matrix: np.ndarray, wanted: int, norm: float) -> list[tuple[float, float, int]]:
    """Intervals (from, to, eigenvalues), upper ones first, that hold the ``wanted`` largest eigenvalues."""
    top, low = norm * 1.01, -norm * 1.01
    parts = [(low, top, len(matrix), 0)]  # from, to, how many lie above from, above to
    out: list[tuple[float, float, int]] = []
    while parts:
        low, top, from_low, from_top = parts.pop()
        if from_top >= wanted or from_low == from_top:
            continue
        if from_low - from_top <= INTERVAL and from_low <= wanted + INTERVAL or top - low <= NARROW * norm:
            out.append((low, top, from_low - from_top))
            continue
        middle = (low + top) / 2
        from_middle = above(matrix, middle)
        parts += [(low, middle, from_low, from_middle), (middle, top, from_middle, from_top)]
    return out


def contour(matrix: np.ndarray, low: float, top: float, count: int, norm: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of an interval, which holds ``count`` of them."""
    n = len(matrix)
    size = min(n, 2 * count + 2)
    rng = np.random.default_rng(seed)
    place, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + place)
    # A little wider than the interval, so that no eigenvalue sits on the circle.
    centre, radius = (low + top) / 2, (top - low) / 2 * 1.05 + 1e-14 * norm
    basis = rng.normal(size=(n, size))
    eye = np.eye(n)
    values, vectors, inside = np.zeros(0), np.zeros((n, 0)), np.zeros(0, bool)
    for turn in range(ROUNDS):
        projected = np.zeros((n, basis.shape[1]))
        for at, w in zip(np.exp(1j * angle), weight, strict=True):
            solved = np.linalg.solve((centre + radius * at) * eye - matrix, basis.astype(complex))
            projected += w / 2 * (radius * at * solved).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        inside = (values > low) & (values <= top) & (residual <= max(n, 8) * RESIDUAL * norm)
        if inside.sum() == count:
            return values[inside], vectors[:, inside]
        basis = vectors
        if turn % 8 == 7:
            # Eigenvalues next to the interval take part of the basis: widen it.
            size = min(n, 2 * size)
            basis = rng.normal(size=(n, size))
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {top}")


def leading(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors as columns."""
    norm = float(np.abs(covariance).sum(axis=1).max(initial=0))
    wanted = min(wanted, len(covariance))
    if not norm or not wanted:
        return np.zeros(wanted), np.eye(len(covariance))[:, :wanted]
    matrix = covariance / norm
    found = [contour(matrix, low, top, count, 1.0, seed) for seed, (low, top, count) in enumerate(intervals(matrix, wanted, 1.0))]
    # All intervals together once more, so that vectors of neighbouring ones are orthogonal.
    basis, _ = np.linalg.qr(np.hstack([vectors for _, vectors in found]))
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    lowest = min(values.min(), min(v.min() for v, _ in found))
    if above(matrix, lowest - 1e-10) < basis.shape[1] or above(matrix, lowest + 1e-10) > basis.shape[1]:
        raise ArithmeticError("eigenvalues are missing")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * norm, (basis @ small)[:, order]


@dataclass
class Fit:
    """What the tasks need of one length of vectors: sums, components and their eigenvalues."""

    n: int
    sums: list[int]
    middle: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    usable: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int], middle: list[int], moments: dict[tuple[int, int], int], components: int) -> Fit:
        dim = len(sums)
        off = [s - n * m for s, m in zip(sums, middle, strict=True)]
        covariance = np.zeros((dim, dim))
        for (i, j), m in moments.items():
            covariance[i, j] = covariance[j, i] = (n * m - off[i] * off[j]) / (n * n)
        trace = sum(n * moments[i, i] - off[i] ** 2 for i in range(dim)) / (n * n) if dim else 0.0
        values, vectors = leading(covariance, components)
        # A component without variance, but for rounding, cannot be brought to variance 1.
        return cls(n, sums, middle, values, vectors, trace, values > 1e-12 * max(trace, 0.0))


def vectors_as_numbers(embedding: Column, scale: int, offset: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long") + offset)


def usable(embedding: Column) -> Column:
    """Not null, and no component null or non-finite."""
    value = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(value, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(~odd, F.lit(False))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length of vectors in a batch."""
    column = batch["x"]
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers; fast where doubles hold them."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def second_moments(rows: DataFrame, middles: dict[int, list[int]]) -> DataFrame:
    """(dim, i, j, n): sums of products of components relative to ``middles``, i <= j."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                y = x - np.array(middles[dim], np.int64)
                for i in range(0, len(y), 4096):
                    found[dim] = found.get(dim, 0) + products(y[i : i + 4096])
        for dim, m in found.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                pa.array([str(v) for v in m[i, j]], pa.string())], ["dim", "i", "j", "n"])

    return rows.select("x").mapInArrow(sums, "dim int, i int, j int, n string").groupBy("dim", "i", "j").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))


def deviations(y: np.ndarray, fit: Fit) -> list[int]:
    """Sums of (n x - S)^2 over dimensions, exact, from components relative to the fit's middles."""
    off = [s - fit.n * m for s, m in zip(fit.sums, fit.middle, strict=True)]
    n, constant = fit.n, sum(o * o for o in off)
    most = int(np.abs(y).max(initial=0))
    if most * max(most, max(map(abs, off), default=0)) * max(1, len(off)) >= 1 << 62:
        y = y.astype(object)
    square, cross = (y * y).sum(axis=1), (y * np.array(off, y.dtype)).sum(axis=1)
    return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(square, cross, strict=True)]


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, fits: dict | None = None,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Kept are vectors of (vec_id, embedding) that are not null and hold no null or non-finite component; components
    become x = floor(scale * c) + offset, where scale * c beyond 2**42 counts as that. Vectors of one length make one
    fit, over all of them: n vectors, their sums S and covariance V with divisor n. Components are its unit
    eigenvectors by falling eigenvalue, at most as many as dimensions; an empty vector has none and gives no row.
    ``whitened`` is x - S/n projected on the component, over the root of its eigenvalue e; null where the vectors do not
    vary along the component. ``explained`` is e / trace(V), null where nothing varies. ``deviation`` is the sum of
    (n x - S)^2, a decimal(38,0), null beyond it. ``identity_error`` is the largest absolute entry of the covariance of
    whitened, measured over its rows, minus the identity, over all lengths; null where there is no component. Rows that
    repeat an id or a vector count each; null ids stay. An empty table gives an empty result. ``fits`` gets the fits.
    """
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", vectors_as_numbers(F.col("embedding"), scale, offset).alias("x"))
    rows = rows.where(F.size("x") > 0)
    # One number for each length and dimension.
    sums = rows.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "x")).groupBy("dim", "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    counts, totals = {r["dim"]: r["n"] for r in sums}, {(r["dim"], r["i"]): int(r["s"]) for r in sums}
    middles = {d: [(2 * totals[d, i] + n) // (2 * n) for i in range(d)] for d, n in counts.items()}
    moments = {(r["dim"], r["i"], r["j"]): int(r["n"]) for r in second_moments(rows, middles).collect()} if counts else {}
    found = {
        d: Fit.of(n, [totals[d, i] for i in range(d)], middles[d], {(i, j): m for (e, i, j), m in moments.items() if e == d}, components)
        for d, n in counts.items()
    }
    if fits is not None:
        fits.update(found)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                fit = found[dim]
                y = x - np.array(fit.middle, np.int64)
                off = np.array([(s - fit.n * m) / fit.n for s, m in zip(fit.sums, fit.middle, strict=True)])
                scores = (y - off) @ fit.vectors
                whitened = [
                    [s / e**0.5 if ok else None for s, e, ok in zip(row, fit.values, fit.usable, strict=True)] for row in scores.tolist()
                ]
                yield pa.RecordBatch.from_arrays([
                    batch["vec_id"].take(pa.array(at)), pa.array([dim] * len(at), pa.int32()),
                    pa.array([str(d) for d in deviations(y, fit)]), pa.array(whitened, pa.list_(pa.float64())),
                ], ["vec_id", "dim", "deviation", "whitened"])

    done = cut(rows.mapInArrow(project, f"vec_id {id_type}, dim int, deviation string, whitened array<double>"), "whitened")
    each = done.groupBy("dim").agg(*_errors(components)).collect() if found else []
    errors = [abs(v) for r in each for v in r[1:] if v is not None]
    told = done.sparkSession.createDataFrame(
        [(d, k, f.n, float(f.values[k]) / f.trace if f.trace else None) for d, f in found.items() for k in range(len(f.values))],
        "dim int, place int, n long, explained double",
    )
    return done.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("place", "whitened")).join(
        F.broadcast(told), ["dim", "place"]
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(max(errors, default=None)).cast("double").alias("identity_error"),
    )


def _errors(components: int) -> list[Column]:
    """Entries of the covariance of whitened minus the identity; null where a component is missing."""
    part = [F.get("whitened", F.lit(k)) for k in range(components)]
    return [
        (F.covar_pop(part[i], part[j]) - float(i == j)).alias(f"e{i}_{j}")
        for i in range(components) for j in range(i, components)
    ]
