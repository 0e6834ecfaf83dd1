"""Embedding near-duplicates by spherical k-means cells and blocked cosine products.

Equal vectors are one class. Centres are fitted by spherical k-means on at most ``sample``
classes; every class is then assigned to the cell of its nearest centre. Two vectors at
distance <= r = sqrt(2 - 2 least) may lie in different cells, so a vector is also a guest of each
cell whose centre it could be nearest to after a move by r: (x.c_home - x.c) / |c_home - c| <=
r. Guests go to cells of higher number only, so each pair meets exactly once, and no pair is
lost. Where vectors have no cell structure at that distance, guests are many and the work is that
of all pairs in blocks.

Cells are split into blocks of ``block`` vectors; each pair of member blocks, or of a member and a guest
block, is a task of its own. A task multiplies in single precision, checks what comes near ``least``
again in double precision, and gives a count for each vector and a spanning star for each
local group, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing (n_links 0, component their own id, kept); vectors of different lengths are not
compared; equal rows are vectors of their own, linked with each other; a component of null ids
only has a null id and all its rows are kept; an empty table gives an empty result; other
columns, such as labels, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import components, cut, ship

LEAST = 0.95
SAMPLE = 20_000
CELL = 4096
MOST_CELLS = 4096
BLOCK = 8192


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of the unit rows x; starts are spread over the rows, empty cells keep their centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9, None]
    return centres


def _valid(embedding):
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(batch: pa.Array, n: int) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def fit_centres(classes: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, np.ndarray]:
    """Centres for each length of vector, fitted on the ``sample`` classes of smallest hash."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = classes.orderBy("h1", "h2").limit(sample).select("dim", "embedding").toArrow()
    out = {}
    for dim, n in sizes.items():
        own = [v for d, v in zip(rows["dim"].to_pylist(), rows["embedding"].to_pylist(), strict=True) if d == dim]
        x = np.array(own, dtype=np.float64).reshape(len(own), dim) if own else np.eye(1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = spherical_kmeans(x, max(1, min(MOST_CELLS, len(x), -(-n // cell))))
    return out


def cells(classes: DataFrame, centres: dict[int, np.ndarray], least: float = LEAST) -> DataFrame:
    """(dim, cell, guest, cid, n, embedding): each class in its cell, and as a guest of cells of higher number in reach."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {d: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for d, c in shared.value.items()}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, own.num_rows, 1024):
                    part = own.slice(at, 1024)
                    x = _matrix(part.column(3), part.num_rows).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    near = x @ shared.value[int(dim)].T
                    home = near.argmax(axis=1)
                    guest = near[np.arange(len(x)), home][:, None] - near <= reach * gaps[int(dim)][home]
                    guest &= np.arange(near.shape[1]) > home[:, None]
                    i, c = np.nonzero(guest)
                    i, c = np.concatenate([np.arange(len(x)), i]), np.concatenate([home, c])
                    flag = np.arange(len(i)) >= len(x)
                    for s in range(0, len(i), 8192):
                        rows = part.take(pa.array(i[s : s + 8192]))
                        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(c[s : s + 8192].astype(np.int32)), pa.array(flag[s : s + 8192]), rows.column(1), rows.column(2), rows.column(3)], names=["dim", "cell", "guest", "cid", "n", "embedding"])

    return classes.select("dim", "cid", "n", "embedding").mapInArrow(run, f"dim int, cell int, guest boolean, cid long, n long, embedding {classes.schema['embedding'].dataType.simpleString()}")


def _products(least: float):
    def one(left: list, right: list | None):
        """Links between two blocks (or within one): positions in left and right."""
        (x, xs), (y, ys) = left, right or left
        for at in range(0, len(x), 512):
            start = 0 if right else at  # within a block, only pairs above the diagonal
            near = xs[at : at + 512] @ ys[start:].T
            i, j = np.nonzero(near >= np.float32(least - 1e-4))
            i, j = i + at, j + start
            if not right:
                i, j = i[j > i], j[j > i]
            for s in range(0, len(i), 65536):
                p, q = i[s : s + 65536], j[s : s + 65536]
                exact = np.einsum("ij,ij->i", x[p], y[q])
                yield p[exact >= least], q[exact >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve():
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                return
            side = t["side"].to_numpy()
            cid, n = t["cid"].to_numpy(), t["n"].to_numpy()
            x = _matrix(t["embedding"].combine_chunks(), t.num_rows).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            xs = x.astype(np.float32)
            a = np.flatnonzero(side == 0)
            b = np.flatnonzero(side == 1)
            within = t["bi"][0].as_py() == t["bj"][0].as_py()
            if not within and (len(a) == 0 or len(b) == 0):
                return
            links, label = np.zeros(len(cid), dtype=np.int64), np.arange(len(cid))
            for p, q in one([x[a], xs[a]], None if within else [x[b], xs[b]]):
                p, q = a[p], (a if within else b)[q]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                while True:  # the smallest position that these links reach
                    old = label.copy()
                    low = np.minimum(label[p], label[q])
                    for z in (p, q, old[p], old[q]):
                        np.minimum.at(label, z, low)
                    label = label[label]
                    if (old == label).all():
                        break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(links[at]), pa.array(cid[label[at]])], names=["cid", "links", "peer"])

        key = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows else []
            edges = [0, *list(new), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                here = tuple(c[s] for c in cols)
                if key is not None and here != key:
                    yield from solve()
                    held = []
                key = here
                held.append(batch.slice(s, e - s))
        if held:
            yield from solve()

    return run


def link(classes: DataFrame, centres: dict[int, np.ndarray], least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(cid, links, peer): for each task and class with links there, how many vectors it links with and a member of its local group."""
    rows = cut(cells(classes, centres, least), "cells")
    sizes = rows.groupBy("dim", "cell").agg(*[F.greatest(F.lit(0), F.ceil(F.sum(F.col("guest").cast("int") if g else (~F.col("guest")).cast("int")) / block)).cast("int").alias(n) for g, n in ((False, "mb"), (True, "gb"))])
    rows = rows.join(sizes, ["dim", "cell"])  # a row for each cell: small, and joined as its size tells
    own = F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("mb"))).cast("int")
    rows = rows.withColumn("own", own + F.when(F.col("guest"), F.col("mb")).otherwise(0))  # guest blocks are numbered after members'
    # members meet every block, guests the members' blocks only
    last = F.when(F.col("guest"), F.col("mb")).otherwise(F.col("mb") + F.col("gb")) - 1
    rows = rows.where("mb > 0").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("dim", "cell", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "n", "embedding")
    key = ["dim", "cell", "bi", "bj"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_products(least), "cid long, links long, peer long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", least: float = LEAST, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    ship(vectors.sparkSession)
    # single precision is exact for floats; anything else is compared as doubles
    single = vectors.schema[embedding_col].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(embedding_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    own = own.withColumn("valid", _valid("embedding")).withColumn("h1", F.when(F.col("valid"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("valid"), F.xxhash64(F.lit(1), "embedding")))
    rows = cut(own.select("vec_id", "h1", "h2"), "vectors")
    classes = own.where("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    found = cut(link(classes, fit_centres(classes, sample, cell), least, block), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("peer").alias("b")), "embedding")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.select("h1", "h2", "cid", "first_id", "n").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    told = cut(told.select("h1", "h2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "told")
    least_id = told.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = cut(told.join(least_id, "root").select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "n_links", "component_id"), "told")
    out = rows.join(told, (rows.h1 == F.col("_1")) & (rows.h2 == F.col("_2")), "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
