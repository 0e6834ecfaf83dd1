import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from postline.llm import simplex
from tests.llm.helpers import collected

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
SCHEMA = "vec_id long, embedding array<double>, cluster int, q string, big string, apex string, h string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dim, scale=256, salt="2:"):
    own = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not own:
        return []
    first = sorted(own, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        home = [near(v)[1] for _, v in own]
        for j in range(len(centroids)):
            mine = [v for (_, v), h in zip(own, home) if h == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [near(v) for _, v in own]
    long = lambda n: n if n < 1 << 63 else None
    inertia = {j: sum(d for d, h in final if h == j) for j in range(len(centroids))}
    fits = {j: all(long(d) is not None for d, h in final if h == j) for j in inertia}
    total = long(sum(inertia.values())) if all(fits.values()) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, long(d), long(inertia[j]) if fits[j] else None, total, digest[j]) for (i, _), (d, j) in zip(own, final)), key=repr)


def clustered(seed, n, dim, scatter=0.2):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [x + scatter * rnd.gauss(0, 1) for x in rnd.choice(centres)]) for i in range(n)]


def test_rounds_equal_plain_k_means(spark):
    rows = clustered(1, 400, 64)
    assert collected(simplex.clusters(frame(spark, rows).repartition(5)), *COLUMNS) == plain(rows, 40, 5, 64)


def test_ties_copies_and_empty_clusters(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(-1, 2)) for _ in range(3)]) for i in range(120)] + [(500 + i, [1.0, 0.0, 0.0]) for i in range(200)] + [(7, [0.0, 0.0, 0.0])] * 3
    assert collected(simplex.clusters(frame(spark, rows), k=25, rounds=3, dim=3), *COLUMNS) == plain(rows, 25, 3, 3)


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (None, None)]
    rows = [*odd, (None, [0.25, -0.25]), (None, [0.25, -0.26]), (7, [3.0, 4.0]), (7, [3.0, 4.0]), (8, [-0.001, 0.001])]
    assert collected(simplex.clusters(frame(spark, rows), k=3, rounds=2, dim=2), *COLUMNS) == plain(rows, 3, 2, 2)
    assert collected(simplex.clusters(frame(spark, rows), k=40, rounds=1, dim=2), *COLUMNS) == plain(rows, 40, 1, 2)
    for empty in ([], odd):
        out = simplex.clusters(frame(spark, empty), k=3, rounds=2, dim=2)
        assert out.collect() == [] and out.columns == list(COLUMNS)


def test_entries_of_any_size_are_compared_exactly(spark):
    rows = clustered(5, 60, 2) + [(100, [1e300, -1e300]), (101, [1e300, -1e299]), (102, [2.0**40, 1.0]), (103, [2.0**40, 1.5]), (104, [-1e17, 3e8])]
    for salt in ("2:", "x", "yy"):
        got = collected(simplex.clusters(frame(spark, rows), k=6, rounds=3, dim=2, salt=salt), *COLUMNS)
        assert got == plain(rows, 6, 3, 2, salt=salt)


def test_bounds_hold_the_distance_and_the_filter_prunes():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(8, 64))
    q = np.floor(256 * (centres[rnd.integers(0, 8, 500)] + 0.1 * rnd.normal(size=(500, 64)))).astype(np.int64)
    base = simplex.Simplex(q[:40].tolist())
    apex, others = base.apex(base.squared(q)), base.apex(base.squared(q[:40]))
    d2 = ((q[:, None, :] - q[None, :40, :]) ** 2).sum(axis=2)
    lower = ((apex[:, None] - others[None]) ** 2).sum(axis=2)
    upper = lower + 4 * apex[:, None, -1] * others[None, :, -1]
    room = simplex.SLACK * ((apex**2).sum(axis=1)[:, None] + (others**2).sum(axis=1))
    assert (lower <= d2 + room).all() and (d2 <= upper + room).all()
    i, j = simplex.candidates(apex, others)
    assert len(i) < 0.5 * d2.size and set(zip(range(500), d2.argmin(axis=1).tolist())) <= set(zip(i.tolist(), j.tolist()))


def test_pivots_on_a_line_or_a_point_are_not_counted_twice():
    line = simplex.Simplex([[0, 0, 0], [10, 10, 10], [20, 20, 20], [5, 5, 5]])
    assert len(line.pivots) == 2
    assert len(simplex.Simplex([[3, 4]] * 5).pivots) == 1
    apex = line.apex(line.squared(np.array([[10, -10, 0], [7, 7, 7]])))
    assert np.allclose(apex[1], [np.sqrt(3) * 7, 0], atol=1e-4) and apex[0, -1] > 14
