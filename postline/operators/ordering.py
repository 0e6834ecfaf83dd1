"""Total orders and distributed ranks.

A rank over a whole table must not be an unpartitioned window (that is one
task).  ``with_global_rank`` sorts with a range-partitioned sort, pins the
sorted partitions with a reliable checkpoint (so every consumer sees the same
partitions, also after an executor loss), counts rows per partition, and adds
each partition's offset (a table with one row per partition) to the
row's position inside its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STATUSES
from ..session import checkpoint_dir


def status_rank(c="status") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for i, s in enumerate(STATUSES, start=1):
        out = F.when(c == s, F.lit(i)) if out is None else out.when(c == s, F.lit(i))
    return out.otherwise(F.lit(len(STATUSES) + 1))


#: The columns that ``review_order`` reads; the last one is unique.
REVIEW_READS = ("status", "match_score", "date_found", "job_hash", "entity_key")


def review_order() -> list[Column]:
    """Status rank, score desc, date_found desc; hash and key make it total."""
    return [
        status_rank("status").asc(),
        F.col("match_score").desc_nulls_last(),
        F.col("date_found").desc_nulls_last(),
        F.col("job_hash").asc(),
        F.col("entity_key").asc(),
    ]


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank", key: str | None = None, reads: tuple[str, ...] = ()) -> DataFrame:
    """df with its position (from 1) in ``order``.

    With ``key``, a column whose values are unique, only it and ``reads``, the columns that ``order`` reads, are
    range-sorted and checkpointed, and the rank is joined back to the rows; without one, whole rows are.
    """
    checkpoint_dir(df.sparkSession)
    if key is None:
        return _ranked(df, order, name)
    ranks = _ranked(df.select(*dict.fromkeys((key, *reads))), order, name).select(F.col(key).alias("_key"), name)
    return df.join(ranks, F.col(key) == F.col("_key")).drop("_key")


def _ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    pinned = df.orderBy(*order).checkpoint(eager=True)
    tagged = pinned.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, so one task and a broadcast are fine
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).select("_pid", "_off")
    ranked = tagged.join(F.broadcast(offsets), "_pid")
    return ranked.withColumn(name, (F.col("_off") + F.col("_local") + 1).cast("long")).drop(
        "_pid", "_local", "_off"
    )


def salted_top_k(df: DataFrame, key: str, order: list[str], k: int, salts: int = 64, name: str = "rn") -> DataFrame:
    """First ``k`` rows per ``key`` by ``order`` (ascending), numbered 1..k.

    Two phases so that a key holding a large share of the rows is never
    one task: a top-k per (key, salt) cuts every key to at most k x salts
    rows, then a top-k per key over that bounded set.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts))
    w1 = Window.partitionBy(F.col(key), F.col("_salt")).orderBy(*[F.col(c) for c in order])
    local = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(F.col(key)).orderBy(*[F.col(c) for c in order])
    return local.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= k).drop("_salt", "_r1")


def ordered_lag(df: DataFrame, key: str, order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """``lag(value)`` within ``key`` by ``order``, safe for a hot key.

    Rows are range-partitioned on (key, order) and pinned by a checkpoint, so
    a hot key spans several partitions.  The lag is taken inside each
    (partition, key) group; the first row of a group takes the last row of
    the previous non-empty partition when it has the same key (a table with
    one row per partition).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(key)] + [F.col(c) for c in order]
    pinned = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    t = pinned.withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid", key).orderBy(*[F.col(c) for c in order])
    t = t.withColumn(name, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = t.groupBy("_pid").agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(*cols)).alias("_last")
    )
    prev = last.withColumn("_prev", F.lag("_last").over(Window.orderBy("_pid"))).select("_pid", "_prev")
    t = t.join(F.broadcast(prev), "_pid", "left")
    fixed = F.when(
        F.col("_first") & (F.col("_prev.k") == F.col(key)), F.col("_prev.v")
    ).otherwise(F.col(name))
    return t.withColumn(name, fixed).drop("_pid", "_first", "_prev")


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast hint only when the row count is proven to be at most ``limit``.

    The count stops at ``limit + 1`` rows, so the check costs little even on
    a large table; above the limit the join is left to the planner.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def broadcast_if_light(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Broadcast hint only when the rows are proven to take at most ``most`` bytes (texts in UTF-8, 16 for each
    value besides); above that the join is left to the planner. For narrow frames that are cheap to read twice."""
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = sum(texts, F.lit(16 * len(df.columns))).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(size).alias("b")).first().b or 0) <= most else df
