"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Candidate search is by pigeonring filtering. The 64 bits are cut into m = max_bits + 1
segments on a ring. If two fingerprints differ in at most t = max_bits bits, some start
segment i exists from which every chain of l consecutive segments differs in at most
floor(l * t / m) bits. So the first segment of that chain is equal (l = 1) and the second
differs in at most floor(2 t / m) = 1 bit, hence one of its two halves is equal as well.
Rows are dealt to buckets by (start, segment, half, value of that half); a pair in a bucket
must then stay within the budget of every longer chain before all 64 bits are compared.

Hot buckets are split: a bucket of more than ``BLOCK`` fingerprints becomes blocks, and each
pair of blocks is a task of its own. A task gives a spanning star for each of its local
groups, never all pairs. Equal fingerprints are one class from the start.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; equal
rows (also equal doc_ids) share a class; null doc_ids come last (a group of null ids only
has a null component_id); an empty table gives an empty result; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm.common import components, cut, free_name, ship

BLOCK = 2048
SMALL = 48


def fingerprint(text: bytes, shingle: int = 4) -> int:
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 2^16 hashes at a time, so a long text needs little memory."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())
        found = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in raw), dtype=np.uint64, count=len(raw))
        return pa.array(found.view(np.int64))

    return of(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(col: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(col, at).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else col


def buckets(classes: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): a row for each start segment and, if there is a next segment, each half of it."""
    fp, rows = F.col("fp"), []
    parts = segments(max_bits)
    for i, (at, width) in enumerate(parts):
        n_at, n_width = parts[(i + 1) % len(parts)]
        low = n_width // 2
        halves = [(n_at, low), (n_at + low, n_width - low)] if max_bits else [(at, 0)]
        rows += [F.struct(F.lit(2 * i + h).alias("slot"), F.xxhash64(_bits(fp, at, width), _bits(fp, *half)).alias("value")) for h, half in enumerate(halves)]
    return classes.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.slot", "k.value", "fp")


def _linked(a: np.ndarray, b: np.ndarray, slot: np.ndarray | int, parts: list[tuple[int, int]], max_bits: int) -> np.ndarray:
    """Which pairs of the flat arrays hold: chains of 2, 3, ... segments from the start within budget, then all bits."""
    live, x = np.arange(len(a)), a ^ b
    m, start = len(parts), np.broadcast_to(np.asarray(slot) // 2, len(a))
    masks = np.array([((1 << w) - 1) << at for at, w in parts], dtype=np.uint64)
    so_far = masks[start]
    live = live[np.bitwise_count(x & so_far) <= max_bits // m]
    for length in range(2, min(m, 4) + 1):
        s = start[live]
        chain = np.zeros(len(live), dtype=np.uint64)
        for j in range(length):
            chain |= masks[(s + j) % m]
        live = live[np.bitwise_count(x[live] & chain) <= length * max_bits // m]
    return live[np.bitwise_count(x[live]) <= max_bits]


def _stars(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b between positions of fps: (node, smallest node of its local group) for each linked node."""
    label = np.arange(len(fps))
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _pairs_of(groups: list[tuple[np.ndarray, np.ndarray, int, bool]], parts: list[tuple[int, int]], max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars of some groups: (fingerprints, block of each, slot, whether only pairs across blocks count)."""
    found = []
    small = [g for g in groups if not g[3] and len(g[0]) <= SMALL]
    if small:
        size = np.array([len(g[0]) for g in small])
        fps, group = np.concatenate([g[0] for g in small]), np.repeat(np.arange(len(small)), size)
        slot = np.repeat(np.array([g[2] for g in small]), size)
        for gap in range(1, int(size.max())):
            at = np.flatnonzero(group[:-gap] == group[gap:])
            if len(at) == 0:
                break
            hit = at[_linked(fps[at], fps[at + gap], slot[at], parts, max_bits)]
            found.append((fps[hit], fps[hit + gap]))
    for fps, block, slot, across in groups:
        if not across and len(fps) <= SMALL:
            continue
        left, right = (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())) if across else (np.arange(len(fps)),) * 2
        la, lb = [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            cols = right if across else right[at:]
            if len(cols) == 0:
                continue
            i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
            hit = _linked(fps[i], fps[j], slot, parts, max_bits)
            i, j = _stars_positions(i[hit], j[hit], len(fps))
            la.append(i), lb.append(j)
        if la:
            found.append(_stars(fps, np.concatenate(la), np.concatenate(lb)))
    return found


def _stars_positions(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(a) <= n:
        return a, b
    return tuple(x.astype(np.int64) for x in _stars(np.arange(n), a, b))


def _search(max_bits: int):
    parts = segments(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray]):
            slot, value, bi, bj, block, fp = cols
            new = np.flatnonzero((slot[1:] != slot[:-1]) | (value[1:] != value[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            edges = [0, *new.tolist(), len(slot)]
            groups = [(fp[x:y], block[x:y], int(slot[x]), bool(bi[x] != bj[x])) for x, y in zip(edges, edges[1:], strict=False) if y - x > 1]
            for a, b in _pairs_of(groups, parts, max_bits):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[5] = cols[5].astype(np.int64).view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(cols[0]) == 0:
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]) & (cols[3] == cols[3][-1])
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [c[last:] for c in cols]
            if last:
                yield from solve([c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield from solve(held)

    return run


def links(classes: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``classes`` (fp long) that span every group linked at max_bits."""
    ship(classes.sparkSession)
    rows = buckets(classes, max_bits)
    hot = rows.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = hot.select("slot", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(hot, ["slot", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("slot", "value", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "fp")
    key = ["slot", "value", "bi", "bj"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_search(max_bits), "a long, b long")


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 4, label: str = "simhash") -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in ``prints`` (id_col, fp): its group and that group's smallest id."""
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), label)
    found = components(links(classes.select("fp"), max_bits), label)
    roots = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots, label)
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return cut(roots.join(least, "root").select("fp", "root", "component_id"), label)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    ship(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "simhash")
    groups = near_duplicates(prints, "doc_id", max_bits)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of docs, all their columns, of which each near-duplicate group keeps one: that of its smallest id."""
    ship(docs.sparkSession)
    fp, no, at = (free_name(docs, n) for n in ("__simhash_fp", "__simhash_no", "__simhash_id"))
    wide = cut(docs.withColumn(fp, fingerprint_column(F.col(text_col), shingle)), "simhash")
    groups = near_duplicates(wide.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp")), "doc_id", max_bits)
    least = wide.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp")).join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = least.groupBy("root").agg(F.min(F.struct("fp", "component_id")).alias("x"))  # of equal ids in a group, one
    best = best.select(F.col("x.fp").alias(fp), F.col("x.component_id").isNull().alias(no), F.coalesce("x.component_id", F.lit(0)).alias(at))
    rows = wide.withColumn(no, F.col(id_col).isNull()).withColumn(at, F.coalesce(F.col(id_col), F.lit(0)))
    return rows.join(best, [fp, no, at], "left_semi").dropDuplicates([fp, no, at]).select(*[F.col(f"`{c}`") for c in docs.columns])
