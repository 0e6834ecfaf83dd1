"""Centroid clustering with n-simplex projection: k-means over integer vectors, exact at any size.

A vector's entries become integers floor(scale * x). A few pivots, chosen among the first
centroids, span a simplex; a vector's exact distances to them are taken once and kept as its apex:
its coordinates within the span of the pivots and its altitude above it. The apexes of a vector and
of a centroid bound their distance from both sides: with altitudes on one side of the base it
is at least the Euclidean distance of the apexes, with one altitude mirrored at most that. A
centroid whose lower bound is above another's upper bound can't be the nearest; what is left
is compared by exact integer distances, so rounding of the apexes never decides.

A round is one pass over the written table of vectors. Each task adds up the vectors of each
cluster and gives k * (entries + 1) whole sums, whatever its rows; Spark adds those up, and the
new centroids (k of them, a parameter) go out with the next round.

Defined cases: vectors that are null, of another length than ``dim``, or hold a null or non-finite entry
are left out; repeated rows are vectors of their own; a null id hashes as an empty text; ties of the hash are ordered
by the vectors' integers; with fewer than k vectors each is a first centroid; an empty table gives an empty
result; a distance, or a sum of distances, that a long can't hold is null (entries of any finite
size are compared exactly); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import cut, ship
from postline.llm.vectors import finite_blocks, fits_long, limbs, list_array, whole

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
PIVOTS = 16
#: Integers up to this size have squared distances that fit a long (64 entries of up to 2 ** 28 apart).
PLAIN = 1 << 27
#: A pivot counts only if it stands this far above the base, as a share of the first edge.
LEAST_ALTITUDE = 1e-3
#: What rounding can take from a bound, as a share of the squared lengths it is made of; far above the real error.
SLACK = 1e-7


def _integers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of finite doubles, exact at any size."""
    return [scale * int(v) if abs(v) >= 1 << 53 else math.floor(scale * v) for v in x.tolist()]


def integer_vectors(vectors: DataFrame, id_col: str, embedding_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, q, big): each kept vector's integers, as ``q`` where all are plain, else as decimal texts in ``big``."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(embedding_col).cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_blocks(batch.column(1)):
                if x.shape[1] != dim:
                    continue
                with np.errstate(over="ignore"):
                    q = np.floor(scale * x)
                plain = (np.abs(q) <= PLAIN).all(axis=1)
                ids = batch.column(0).take(pa.array(at))
                if plain.any():
                    n = int(plain.sum())
                    yield pa.RecordBatch.from_arrays([ids.filter(pa.array(plain)), list_array(q[plain].astype(np.int32), pa.int32()), pa.nulls(n, pa.list_(pa.string()))], names=["vec_id", "q", "big"])
                if not plain.all():
                    big = [[str(v) for v in _integers(row, scale)] for row in x[~plain]]
                    yield pa.RecordBatch.from_arrays([ids.filter(pa.array(~plain)), pa.nulls(len(big), pa.list_(pa.int32())), pa.array(big, pa.list_(pa.string()))], names=["vec_id", "q", "big"])

    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, q array<int>, big array<string>")


def first_centroids(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest sha256(salt + id), in that order.

    Hashes are spread evenly, so a prefix of the hash range that should hold a few times k vectors
    is read first and widened until k are found; only those are sorted.
    """
    n = kept.count()
    hashed = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    share = 8 * k / max(n, 1)
    while True:
        near = hashed if share >= 1 else hashed.where(F.col("h") < f"{int(share * 2**60):015x}")
        rows = near.orderBy("h", "q", "big").limit(k).collect()
        if len(rows) == min(k, n):
            return [list(r.q) if r.q is not None else [int(v) for v in r.big] for r in rows]
        share *= 8


class Simplex:
    """A base of pivots; ``apex`` turns squared distances to them into coordinates and an altitude."""

    def __init__(self, points: list[list[int]], most: int = PIVOTS):
        plain = [p for p in points if max(map(abs, p)) <= PLAIN]
        x = np.array(plain, dtype=np.float64)
        chosen, first = [0] if plain else [], 0.0
        left = x - x[0] if plain else x
        while chosen and len(chosen) < most:
            height = np.sqrt((left**2).sum(axis=1))  # altitude of each point above the base so far
            far = int(height.argmax())
            if height[far] == 0 or height[far] < LEAST_ALTITUDE * first:
                break
            first = first or height[far]
            up = left[far] / height[far]
            chosen.append(far)
            left = left - np.outer(left @ up, up)
        self.pivots = np.array([plain[i] for i in chosen], dtype=np.int64).reshape(len(chosen), len(plain[0]) if plain else 0)
        edges = self.pivots[1:] - self.pivots[:1]
        self.norms = (edges**2).sum(axis=1).astype(np.float64)
        corner = np.linalg.cholesky((edges @ edges.T).astype(np.float64)) if len(edges) else np.zeros((0, 0))
        self.solve = np.linalg.inv(corner).T if len(edges) else corner

    def squared(self, q: np.ndarray) -> np.ndarray:
        """Exact squared distances of integer rows to the pivots."""
        out = np.empty((len(q), len(self.pivots)), dtype=np.int64)
        for j, p in enumerate(self.pivots):
            out[:, j] = ((q - p) ** 2).sum(axis=1)
        return out

    def apex(self, d2: np.ndarray) -> np.ndarray:
        d = d2.astype(np.float64)
        y = ((d[:, :1] - d[:, 1:] + self.norms) / 2) @ self.solve
        return np.column_stack([y, np.sqrt(np.maximum(d[:, 0] - (y**2).sum(axis=1), 0))])


def with_apexes(kept: DataFrame, base: Simplex) -> DataFrame:
    """(vec_id, q, big, apex): the distances to the pivots, taken once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = np.zeros((batch.num_rows, len(base.pivots)))
            for at, q in finite_blocks(batch.column(1)):
                apex[at] = base.apex(base.squared(q.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(apex, pa.float64())], names=["vec_id", "q", "big", "apex"])

    if not len(base.pivots):
        return kept.withColumn("apex", F.lit(None).cast("array<double>"))
    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, q array<int>, big array<string>, apex array<double>")


def candidates(apex: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid) pairs whose lower bound isn't above the row's smallest upper bound."""
    x, c = (apex**2).sum(axis=1)[:, None], (of_centroids**2).sum(axis=1)
    lower = x + c - 2 * apex @ of_centroids.T
    upper = lower + 4 * apex[:, -1:] * of_centroids[:, -1]
    return np.nonzero(lower <= upper.min(axis=1, keepdims=True) + SLACK * (x + c))


def nearest(q: np.ndarray, apex: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid by exact comparison of the candidates; ties: smaller number."""
    i, j = candidates(apex, of_centroids)
    d = np.concatenate([((q[i[s : s + 65536]] - centroids[j[s : s + 65536]]) ** 2).sum(axis=1) for s in range(0, len(i), 65536)])
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    least = np.minimum.reduceat(d, starts)
    hit = np.flatnonzero(d == least[i])
    first = hit[np.r_[True, i[hit][1:] != i[hit][:-1]]]
    return j[first], least


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], base: Simplex) -> Iterator[tuple[np.ndarray, np.ndarray | list, np.ndarray, list[int], pa.RecordBatch]]:
    """For blocks of rows: positions, integers, clusters, distances and the batch they are from."""
    plain = all(max(map(abs, c)) <= PLAIN for c in centroids)
    own = np.array(centroids, dtype=np.int64) if plain else None
    apexes = base.apex(base.squared(own)) if plain else None
    for batch in batches:
        exact: list[tuple[int, list[int]]] = []
        for at, x in finite_blocks(batch.column(1)):
            q = x.astype(np.int64)
            if not plain:
                exact += zip(at.tolist(), q.tolist(), strict=True)
                continue
            apex = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
            home, distance = nearest(q, apex, own, apexes)
            yield at, q, home, distance, batch
        at = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        exact += [(i, [int(v) for v in batch.column(2)[i].as_py()]) for i in at.tolist()]
        for i, v in exact:  # beyond what a long holds: whole numbers, one by one
            d, home = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
            yield np.array([i]), [v], np.array([home]), [d], batch


def new_centroids(table: DataFrame, centroids: list[list[int]], base: Simplex) -> list[list[int]]:
    """One round: floor(sum / count) of each cluster's vectors; an empty cluster keeps its centroid."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dim + 1), dtype=np.int64)  # the last part counts the vectors
        large: dict[int, list[int]] = {}
        for _, q, home, _, _ in _assigned(batches, centroids, base):
            if isinstance(q, list):
                own = large.setdefault(int(home[0]), [0] * (dim + 1))
                large[int(home[0])] = [a + b for a, b in zip(own, [*q[0], 1], strict=True)]
                continue
            order = np.argsort(home, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
            sums[home[order][starts]] += np.column_stack([np.add.reduceat(q[order], starts, axis=0), np.diff(np.r_[starts, len(order)])])
        told = [(c, p, *d) for c in range(len(centroids)) for p in range(dim + 1) for d in limbs(int(sums[c, p]) + (large[c][p] if c in large else 0))]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*told, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "part", "place", "digit"])

    parts = table.mapInArrow(run, "cluster int, part int, place int, digit long")
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("cluster", "part", "place").agg(F.sum("digit").alias("digit")).collect():  # at most k * (dim + 1) numbers
        total.setdefault((r.cluster, r.part), {})[r.place] = r.digit
    out = []
    for c, before in enumerate(centroids):
        n = whole(total.get((c, dim), {}))
        out.append([whole(total.get((c, p), {})) // n for p in range(dim)] if n else before)
    return out


def assign(table: DataFrame, centroids: list[list[int]], base: Simplex) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, home, distance, batch in _assigned(batches, centroids, base):
            d = pa.array(distance, pa.int64()) if isinstance(distance, np.ndarray) else pa.array([fits_long(v) for v in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(home.astype(np.int32)), d], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "2:", pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of ``dim`` finite entries."""
    spark = vectors.sparkSession
    ship(spark)
    kept = cut(integer_vectors(vectors, id_col, embedding_col, dim, scale), "integers")
    centroids = first_centroids(kept, k, salt)
    base = Simplex(centroids, pivots)
    table = cut(with_apexes(kept, base), "apexes")
    for _ in range(rounds if centroids else 0):
        centroids = new_centroids(table, centroids, base)
    if not centroids:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    told = cut(assign(table, centroids, base), "assigned")
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = {r.cluster: r.d for r in told.groupBy("cluster").agg(exact.alias("d")).collect()}  # one row a cluster
    inertia = None if None in own.values() else fits_long(int(sum(own.values())))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, fits_long(int(d)) if d is not None else None, inertia, digest[c]) for c, d in sorted(own.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
