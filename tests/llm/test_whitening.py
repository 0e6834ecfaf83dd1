import math
import random
from fractions import Fraction

import numpy as np
import pytest

from postline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n string, dim string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, most=32):
    """n, sums, deviations and numpy's eigenvalues over the vectors that take part."""
    own = [(i, [math.floor(64 * Fraction(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(own), len(own[0][1])
    sums = [sum(c) for c in zip(*[v for _, v in own])]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for _, v in own]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for _, v in own])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return own, n, deviation, centred, values[::-1][: min(most, dim)], vectors[:, ::-1][:, : min(most, dim)], np.trace(v)


def check(got, rows, most=32):
    own, n, deviation, centred, values, vectors, trace = plain(rows, most)
    k = int((values > 1e-10 * values[0]).sum())
    assert len(got) == len(own) * k and {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-6
    for c in range(1, k + 1):
        mine = [r for r in got if r.component == c]
        assert all(abs(r.explained - values[c - 1] / trace) <= 1e-8 * values[c - 1] / trace for r in mine)
        want = sorted(zip([repr(i) for i, _ in own], deviation, (centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])).tolist()))
        have = sorted((repr(r.vec_id), r.deviation, r.whitened) for r in mine)
        assert [x[:2] for x in have] == [x[:2] for x in want]
        a, b = np.array([x[2] for x in have]), np.array([x[2] for x in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def spread(seed, n, dim):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + 0.3 * (1 + j / dim) * rnd.gauss(0, 1) for j, c in enumerate(rnd.choice(centres))]) for i in range(n)]


def test_components_equal_a_dense_decomposition(spark):
    rows = spread(1, 500, 48)
    check(whitening.whitening(frame(spark, rows).repartition(5)).collect(), rows)


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 0.0]), (None, None)]
    rows = [*odd, (None, [0.5, 1.0, -2.0]), (7, [3.0, 4.0, 1.0]), (7, [3.0, 4.0, 1.0]), (8, [-1.001, 0.001, 9.0]), (9, [0.0, 0.0, 0.0])]
    check(whitening.whitening(frame(spark, rows)).collect(), rows)
    assert whitening.whitening(frame(spark, [(1, [1e300, 0.0])])).collect() == []
    for empty in ([], odd, [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        out = whitening.whitening(frame(spark, empty))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_lengths_are_fitted_apart_and_large_entries_stay_exact(spark):
    two, three = spread(2, 40, 2), [(100 + i, [1e9 * c for c in v]) for i, v in spread(3, 40, 3)]
    got = whitening.whitening(frame(spark, two + three)).collect()
    check([r for r in got if r.vec_id < 100], two)
    own, n, deviation, *_ = plain(three)
    assert {(r.vec_id, r.deviation) for r in got if r.vec_id >= 100} == {(i, d if d < 1 << 63 else None) for (i, _), d in zip(own, deviation)}
    few = spread(4, 5, 12)  # fewer vectors than entries: four components
    check(whitening.whitening(frame(spark, few)).collect(), few)


@pytest.mark.parametrize("values", [[9, 5, 3, 2, 1.5, 1, 0.5, 0.1], [4, 4, 4, 4, 4, 1, 1, 1], [1e6, 1, 1e-6, 1e-7], [7], [2.0] * 40, [*np.geomspace(1, 1e-6, 70)], [1.0, 1 - 1e-12, 1 - 2e-12, 0.5], [*[3.0] * 20, *[2.0] * 20, *[1.0] * 20], [5, 0, 0, 0]])
def test_feast_finds_every_eigenvalue(values):
    d = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    v = (turn * np.array(values, dtype=float)) @ turn.T
    v = (v + v.T) / 2
    got, vectors = whitening.components(v, min(32, d))
    want = np.sort(np.array(values, dtype=float))[::-1][: min(32, d)]
    want = want[want > 1e-10 * want[0]]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-13 * want[0] * d
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * want[0]


def test_inertia_counts():
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(30, 30))
    v = a @ a.T
    tri, shifts = whitening.tridiagonal(v), np.linspace(-1, 120, 200)
    assert (whitening.below(*tri, shifts) == (np.linalg.eigvalsh(v)[:, None] < shifts).sum(axis=0)).all()
    for low, high, count in whitening.intervals(v, 12):
        assert count == ((np.linalg.eigvalsh(v) > low) & (np.linalg.eigvalsh(v) < high)).sum()
