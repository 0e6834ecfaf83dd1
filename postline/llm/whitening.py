"""Embedding whitening; principal components by FEAST contour integration.

An entry c becomes the integer x = floor(scale * c) + offset. Counts, sums and the second moments about the
whole part of the mean are exact integers: tasks add them up, Spark adds up the tasks' sums (dim * (dim + 1) / 2
of them, whatever the rows), and the covariance (divisor n, the rest of the mean removed exactly) is rounded
once. The driver holds only that matrix, whose size is the square of the vectors' length.

Its largest eigenvalues come by FEAST: inertia counts (negative pivots of the shifted matrix, by Sylvester's law)
place intervals into gaps of the spectrum; for each interval, quadrature over complex shifted solves around it
projects a random block onto its eigenvectors, Rayleigh-Ritz extracts them, and rounds go on until residuals
are at rounding; the inertia counts at both ends say how many there must be, and a block that
holds fewer is widened, so none is missed. A last Rayleigh-Ritz over all found makes them orthogonal.

Two more passes measure the covariance of the whitened rows and write them.

Defined cases: vectors that are null or hold a null or non-finite entry are left out, and so are empty ones and those
with an x beyond a long; vectors of different lengths are fitted apart, each length over its own
rows; repeated rows are vectors of their own; a component whose eigenvalue is at most LEAST times the
largest (as of constant vectors, or of fewer vectors than entries) can't be whitened and has no rows, so one vector
alone has none; a deviation beyond a long is null; an empty table gives an empty result; ids may be null; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import cut, ship
from postline.llm.vectors import finite_blocks, limbs, list_array, whole

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Eigenvalues up to this share of the largest are taken as zero.
LEAST = 1e-10
#: Integers up to this size have exact products in doubles, summed over a block of 2048 rows.
EXACT = 1 << 20


def integer_vectors(vectors: DataFrame, id_col: str, embedding_col: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(embedding_col).cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, c in finite_blocks(batch.column(1)):
                good = (np.abs(c) < 2.0**62 / scale).all(axis=1)
                x = np.floor(scale * c[good]).astype(np.int64) + offset
                if len(x):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[good])), list_array(x, pa.int64())], names=["vec_id", "x"])

    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, x array<long>")


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, long matrix) in blocks of one length; every list is whole."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        for at in range(0, len(own), 2048):
            part = own[at : at + 2048]
            yield part, flat[starts[part][:, None] + np.arange(dim)]


def _column_sums(x: np.ndarray) -> list[int]:
    if np.abs(x).max() < 1 << 50:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


_PARTS = "dim int, i int, j int, place int, digit long"


def _part_rows(sums: dict[tuple[int, int, int], int]) -> Iterator[pa.RecordBatch]:
    rows = [(*k, *d) for k, v in sums.items() for d in limbs(v)]
    for s in range(0, len(rows), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == 4 else pa.int32()) for c, v in enumerate(zip(*rows[s : s + 65536], strict=True))], names=["dim", "i", "j", "place", "digit"])


def _added(parts: DataFrame) -> dict[tuple[int, int, int], int]:
    """The exact sums by (dim, i, j); as many numbers as a covariance has, times the digits' places."""
    out: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in parts.groupBy("dim", "i", "j", "place").agg(F.sum("digit").alias("digit")).collect():
        out.setdefault((r.dim, r.i, r.j), {})[r.place] = r.digit
    return {k: whole(d) for k, d in out.items()}


def first_moments(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, sums) for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                dim = x.shape[1]
                for i, v in enumerate([*_column_sums(x), len(x)]):  # the last one counts the vectors
                    sums[dim, i, 0] = sums.get((dim, i, 0), 0) + v
        yield from _part_rows(sums)

    total = _added(table.select("x").mapInArrow(run, _PARTS))
    return {dim: (n, [total.get((dim, i, 0), 0) for i in range(dim)]) for (dim, i, _), n in sorted(total.items()) if i == dim}


def _centred(x: np.ndarray, mean: list[int]) -> np.ndarray:
    """x minus the whole part of the mean: longs where they surely fit, else Python's integers."""
    if np.abs(x).max() < 1 << 61 and max(map(abs, mean)) < 1 << 61:
        return x - np.array(mean, dtype=np.int64)
    return x.astype(object) - np.array(mean, dtype=object)


def second_moments(table: DataFrame, means: dict[int, list[int]]) -> dict[tuple[int, int, int], int]:
    """Exact sums of (x_i - mean_i) * (x_j - mean_j), i <= j, the means whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                z = _centred(x, means[x.shape[1]])
                small = (np.abs(z) < EXACT).all(axis=1).astype(bool)
                zs, zl = z[small].astype(np.float64), z[~small].astype(object)
                own = (zs.T @ zs).astype(np.int64).astype(object)  # whole numbers below 2 ** 53
                if len(zl):
                    own = own + zl.T.dot(zl)
                total[x.shape[1]] = total.get(x.shape[1], 0) + own
        yield from _part_rows({(dim, i, j): int(m[i, j]) for dim, m in total.items() for i in range(dim) for j in range(i, dim)})

    return _added(table.select("x").mapInArrow(run, _PARTS))


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with v's eigenvalues (Householder reflections)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(x, x @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    count, pivot = np.zeros(len(shifts), dtype=int), np.ones(len(shifts))
    tiny = np.finfo(float).tiny ** 0.5
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def intervals(v: np.ndarray, wanted: int, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top down, with ends in gaps of the spectrum, until ``wanted`` eigenvalues are covered."""
    d = len(v)
    tri = tridiagonal(v)
    reach = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9) + np.finfo(float).tiny
    low, high = np.full(min(wanted + 1, d), -reach), np.full(min(wanted + 1, d), reach)
    rank = d - 1 - np.arange(len(low))  # the k-th largest has so many below it
    for _ in range(48):
        middle = (low + high) / 2
        over = below(*tri, middle) <= rank  # the eigenvalue isn't below the middle
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    about = (low + high) / 2
    gaps = about[:-1] - about[1:]
    out, at, top = [], 0, reach
    while at < min(wanted, d):
        ends = np.arange(at, min(at + most, len(gaps)))  # an interval may end behind any of these
        while len(ends) and gaps[ends].max() <= 1e-9 * reach and ends[-1] + 1 < len(gaps):  # a cluster isn't cut
            ends = np.append(ends, ends[-1] + 1)
        if len(ends) == 0 or at + most >= d and len(about) == d or gaps[ends].max() <= 1e-9 * reach:
            out.append((-reach, top, d - at if len(about) == d else int(below(*tri, np.array([top]))[0])))
            break
        end = int(ends[gaps[ends].argmax()])
        bottom = float(about[end] + about[end + 1]) / 2
        counts = below(*tri, np.array([bottom, top]))
        out.append((bottom, top, int(counts[1] - counts[0])))
        at, top = end + 1, bottom
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0, nodes: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues within (low, high) and their unit vectors, by contour integration and Rayleigh-Ritz."""
    d, size = len(v), float(np.abs(v).sum(axis=1).max()) or 1.0
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    turn = radius * np.exp(-0.5j * np.pi * (at - 1))  # the upper half circle; the lower one mirrors it
    block = min(d, count + max(4, count // 2))
    while True:
        y = np.random.default_rng(seed).standard_normal((d, block))
        for _ in range(rounds):
            if block < d:
                y = sum(w / 2 * (t * np.linalg.solve((centre + t) * np.eye(d) - v, y)).real for t, w in zip(turn, weight, strict=True))
            left, scale, _ = np.linalg.svd(y, full_matrices=False)
            basis = left[:, scale > 1e-14 * scale[0]]
            values, inner = np.linalg.eigh(basis.T @ v @ basis)
            y = basis @ inner
            inside = (values > low) & (values < high)
            worst = np.abs(v @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
            if inside.sum() == count and worst <= 1e-14 * size * d**0.5:
                return values[inside], y[:, inside]
            if block == d:
                near = np.argsort(np.abs(values - centre))[:count]  # every eigenvalue is in the block: those that the counts place inside
                return values[near], y[:, near]
        block = min(d, 2 * block)


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit vectors as columns) of the covariance v, at most ``most``, none of zero."""
    size = float(np.abs(v).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v / size, *part, seed=k) for k, part in enumerate(intervals(v / size, most))]
    basis, _ = np.linalg.qr(np.column_stack([x for _, x in found]))
    values, inner = np.linalg.eigh(basis.T @ (v / size) @ basis)
    order = np.argsort(-values)[:most]
    order = order[values[order] > LEAST * values[order[0]]]
    vectors = basis @ inner[:, order]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[order] * size, vectors * np.sign(lead)


@dataclass
class Fit:
    """What whitening of one length needs: count, whole part of the mean, what is left of the sums, spectrum, whitening matrix."""

    n: int
    mean: list[int]
    rest: list[int]  # sums - n * mean, from 0 to n - 1
    explained: np.ndarray
    matrix: np.ndarray  # a column for each component, over the root of its eigenvalue
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return (_centred(x, self.mean).astype(np.float64) - rest) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2: n * n * sum(z * z) - 2 * n * sum(z * rest) + sum(rest * rest), whole numbers."""
        z = _centred(x, self.mean)
        if z.dtype == object or np.abs(z).max(initial=0) >= 1 << 24 or self.n >= 1 << 32:
            z = z.astype(object)
        square, cross = (z * z).sum(axis=1).astype(object), (z * np.array(self.rest, dtype=z.dtype)).sum(axis=1).astype(object)
        out = self.n**2 * square - 2 * self.n * cross + sum(r * r for r in self.rest)
        return [int(v) if v < 1 << 63 else None for v in out]


def fit(table: DataFrame, most: int) -> dict[int, Fit]:
    out = {}
    first = first_moments(table)
    means = {dim: [s // n for s in sums] for dim, (n, sums) in first.items()}
    second = second_moments(table, means) if means else {}
    for dim, (n, sums) in first.items():
        rest = [s - n * m for s, m in zip(sums, means[dim], strict=True)]
        v = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                v[i, j] = v[j, i] = (n * second.get((dim, i, j), 0) - rest[i] * rest[j]) / n**2
        values, vectors = components(v, min(most, dim))
        out[dim] = Fit(n, means[dim], rest, values / max(np.trace(v), np.finfo(float).tiny), vectors / np.sqrt(values))
    return out


def with_errors(table: DataFrame, fits: dict[int, Fit]) -> dict[int, Fit]:
    """The fits with their identity_error, measured over all whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                w = fits[x.shape[1]].whitened(x)
                w = np.column_stack([w, np.ones(len(w))])  # the last row of the products has the sums
                total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        rows = [(dim, i, j, float(m[i, j])) for dim, m in total.items() for i in range(len(m)) for j in range(len(m))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["dim", "i", "j", "v"])

    parts = table.select("x").mapInArrow(run, "dim long, i long, j long, v double")
    sums = {(r.dim, r.i, r.j): r.v for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()}  # (components + 1) ** 2 numbers
    for dim, f in fits.items():
        k = f.matrix.shape[1]
        if k:
            m = np.array([[sums[dim, i, j] for j in range(k + 1)] for i in range(k + 1)]) / f.n
            f.identity_error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())
    return fits


def whitening(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each component."""
    ship(vectors.sparkSession)
    table = cut(integer_vectors(vectors, id_col, embedding_col, scale, offset), "vectors")
    fits = with_errors(table, fit(table, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column(1)):
                f = fits[x.shape[1]]
                k = f.matrix.shape[1]
                if not k:
                    continue
                w, rows = f.whitened(x), len(x) * k
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                own = pa.array(f.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, f.n, dtype=np.int64)), own, pa.array(w.ravel()), pa.array(np.tile(f.explained, len(x))), pa.array(np.full(rows, f.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
