import math
import random

import numpy as np

from postline.llm import embeddings
from tests.llm.helpers import collected

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, n long, h1 string"
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA)


def plain(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if k else None for (_, v), k in zip(rows, ok)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((vec_id, links[i], min(ids, default=None), vec_id == min(ids, default=None)))
    return sorted(out, key=repr)


def clustered(seed, n, dim=8, noise=0.16):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [x + noise * rnd.gauss(0, 1) for x in rnd.choice(centres)]) for i in range(n)]


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [3.0, 0.1]), (None, None), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (3, [0.0, 0.0])]
    assert collected(embeddings.near_duplicates(frame(spark, rows)), *COLUMNS) == plain(rows)
    assert embeddings.near_duplicates(frame(spark, [])).collect() == []


def test_cells_blocks_and_guests_lose_no_link(spark):
    rows = clustered(1, 260)
    assert collected(embeddings.near_duplicates(frame(spark, rows), cell=20, block=16, sample=100), *COLUMNS) == plain(rows)


def test_a_hot_group_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(150)] + [(1000 + i, [1.0, 2.0, 3.0 + i / 1000]) for i in range(50)] + [(5000 + i, v) for i, v in clustered(2, 60, dim=3)]
    assert collected(embeddings.near_duplicates(frame(spark, rows), cell=30, block=16), *COLUMNS) == plain(rows)


def test_centres_are_unit_vectors():
    x = np.random.default_rng(1).normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embeddings.spherical_kmeans(x, 12)
    assert c.shape == (12, 6) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert (x @ c.T).max(axis=1).mean() > (x @ x[:12].T).max(axis=1).mean()


def test_doubles_are_compared_as_doubles(spark):
    # the cosine is 0.95 to within 1e-12 on either side; as floats both vectors would be the same
    at = math.acos(0.95)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(at - 1e-11), math.sin(at - 1e-11)]), (3, [0.0, 5.0]), (4, [5 * math.sin(at + 1e-11), 5 * math.cos(at + 1e-11)])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    whole = spark.createDataFrame([(1, [3, 4]), (2, [6, 8]), (3, [4, -3])], "vec_id long, embedding array<int>")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(whole).collect()} == {1: 1, 2: 1, 3: 3}
