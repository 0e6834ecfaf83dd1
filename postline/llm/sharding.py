"""Sharding indivisible groups by best-fit-decreasing bin packing.

Rows with equal text are a group and stay together. A group of at least ``1 / FINE`` of a
bin's share is an item; smaller groups are first gathered by a hash of their text into chunks of
about that size. So the items of a region are bounded (a region is a fixed number of bins),
whatever the number of groups. Items sorted by size each enter the bin with the least room that still
holds them, found in a balanced tree of the bins' rooms.

``fixed_shards`` asks for a number of shards: the capacity is then the smallest for which the
packing needs no more of them, found by bisection; a group over the mean share has a shard for
itself. ``pack_capacity`` asks for a capacity: regions are packed by tasks of their own.

Defined cases: a null text counts as empty; an empty text has size 1; equal rows are rows of
their own in one group; a group larger than the capacity fills a shard alone; with fewer
items than shards some stay empty; an empty table gives an empty result; null ids are ids like
others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postline.llm.common import cut, numbered, ship

FINE = 512
REGION = 256


class Rooms:
    """A treap of (room, bin), balanced by a hash of the bin; all steps are logarithmic."""

    def __init__(self):
        self.root: list | None = None  # [key, priority, left, right]

    @classmethod
    def _split(cls, t, key):
        """The nodes below key, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = cls._split(t[3], key)
            t[3] = a
            return t, b
        a, b = cls._split(t[2], key)
        t[2] = b
        return a, t

    @classmethod
    def _join(cls, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] < b[1]:
            a[3] = cls._join(a[3], b)
            return a
        b[2] = cls._join(a, b[2])
        return b

    def add(self, room: int, which: int) -> None:
        key = (room, which)
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, [key, which * 2654435761 % 2**32, None, None]), b)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and give the bin with the smallest room that is at least ``least``."""
        a, b = self._split(self.root, (least, -1))
        if b is None:
            self.root = a
            return None
        first = b
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(b, (first[0][0], first[0][1] + 1))
        self.root = self._join(a, rest)
        return first[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> tuple[list[int], int] | None:
    """The bin of each of sizes (in falling order) and their number; None if more than ``most`` bins are needed."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        rooms.add(found[0] - size, found[1])
    return out, bins


def into_fixed(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """name -> shard for items (size, name): bins of the least capacity that suffices."""
    order = sorted(items, key=lambda x: (-x[0], x[1]))
    out, left, free = {}, sum(size for size, _ in order), shards
    while order and free > 1 and order[0][0] * free > left:  # over the mean share of what is left
        size, name = order.pop(0)
        out[name], left, free = shards - free, left - size, free - 1
    sizes = [size for size, _ in order]
    low, high = max([-(-left // free), *sizes[:1]]), max(1, left)
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle, free):
            high = middle
        else:
            low = middle + 1
    bins = best_fit_decreasing(sizes, low, free)[0]
    return out | {name: shards - free + b for (_, name), b in zip(order, bins, strict=True)}


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("gid"))


def items_of(groups: DataFrame, share: float, regions: int, chunks: int) -> DataFrame:
    """groups (gid, bytes) and the item each belongs to: ``region``, ``item`` (its own name, or that of a chunk)."""
    region = F.pmod(F.xxhash64("gid", F.lit(11)), F.lit(regions)).cast("int")
    chunk = F.concat(F.lit("c"), F.pmod(F.xxhash64("gid", F.lit(13)), F.lit(chunks)).cast("string"))
    return groups.select("gid", "bytes", region.alias("region"), F.when(F.col("bytes") >= share, F.hex("gid")).otherwise(chunk).alias("item"))


def fixed_shards(rows: DataFrame, shards: int = 8) -> DataFrame:
    """rows (of rows_of) and ``shard``, 0 to shards - 1."""
    groups = rows.groupBy("gid").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("x")).first().x
    groups = cut(items_of(groups, max(1.0, total / (shards * FINE)), 1, shards * FINE), "groups")
    items = groups.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 shards FINE rows
    where = into_fixed([(r.bytes, r.item) for r in items], shards)
    table = rows.sparkSession.createDataFrame(sorted(where.items()), "item string, shard int")
    groups = groups.join(F.broadcast(table), "item").select("gid", "shard")
    return rows.join(groups, "gid")


def pack_capacity(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (of rows_of) and ``shard`` (long, from 0 without gaps), none of more than capacity bytes but for a larger group alone."""
    spark = rows.sparkSession
    ship(spark)
    groups = rows.groupBy("gid").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("x")).first().x
    regions = max(1, -(-total // (capacity * REGION)))
    bins = -(-total // (capacity * regions))
    groups = cut(items_of(groups, max(1.0, capacity / FINE), regions, max(1, bins) * FINE), "groups")

    def region(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for t in tables:
            order = sorted(zip(t["bytes"].to_pylist(), t["item"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
            found, _ = best_fit_decreasing([s for s, _ in order], capacity)
            yield pa.table({"region": [t["region"][0].as_py()] * len(order), "item": [n for _, n in order], "bin": pa.array(found, pa.int32())}, schema=pa.schema([("region", pa.int32()), ("item", pa.string()), ("bin", pa.int32())]))

    items = groups.groupBy("region", "item").agg(F.sum("bytes").alias("bytes"))
    packed = cut(items.groupBy("region").applyInArrow(lambda t: next(region(iter([t]))), "region int, item string, bin int"), "bins")
    used = packed.groupBy("region").agg((F.max("bin") + 1).alias("bins"))
    used = used.withColumn("first", F.coalesce(F.sum("bins").over(W.orderBy("region").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("region", "first")
    where = packed.join(used, "region").select("region", "item", (F.col("first") + F.col("bin")).cast("long").alias("shard"))
    return rows.join(groups.join(where, ["region", "item"]).select("gid", "shard"), "gid")


def sharding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null) for every row of docs."""
    rows = cut(rows_of(docs, id_col, text_col), "rows")
    dealt = fixed_shards(rows, shards).select("doc_id", "size", "text_crc32", "shard")
    out = numbered(dealt, ["shard"], ["doc_id", "text_crc32"], ["doc_id", "text_crc32", "size"], "slot", "slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
