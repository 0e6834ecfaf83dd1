"""The stored table in buckets of its key: a merge reads and rewrites only the buckets that its batch touches.

The table is a folder ``bucket=<n>/`` for each value of a hash of ``entity_key``; ``_buckets`` beside them
says how many there are. A merge prunes its read to the batch's buckets, writes the merged rows aside, and then replaces
those buckets (dynamic partition overwrite); files of other buckets stay as they are. A merge has a tag: running it again
after a lost driver takes the rows written aside, if they were complete, and replaces the buckets once more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge

BUCKET = "bucket"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_key"), F.lit(buckets)).cast("int")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _replace(rows: DataFrame, root: str) -> None:
    """Write rows over the buckets that they are in."""
    rows = rows.repartition(BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(root)


def create(store: DataFrame, root: str, buckets: int) -> None:
    """Write a stored table into ``buckets`` buckets."""
    root = root.rstrip("/")
    store.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/_buckets")
    _replace(store.withColumn(BUCKET, bucket_of(buckets)), root)


def count(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root.rstrip('/')}/_buckets").first().buckets


def read(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The stored table, or the given buckets of it (the others' files aren't opened)."""
    found = _there(spark, root.rstrip("/"))
    if found is None:
        return merge.empty_store(spark)
    return (found if only is None else found.filter(F.col(BUCKET).isin(only))).drop(BUCKET)


def touched(batch: DataFrame, buckets: int, eligible: str | None = None) -> list[int]:
    """The buckets of the batch's entities; ineligible rows touch none. At most ``buckets`` numbers."""
    rows = batch.filter(F.col(eligible)) if eligible else batch
    return sorted(r[0] for r in rows.select(bucket_of(buckets).alias("b")).distinct().collect())


def merge_batch(spark: SparkSession, root: str, batch: DataFrame, as_of, tag: str, eligible: str | None = None, **options) -> DataFrame:
    """Merge a batch (``merge.upsert``) into the table; returns the merged rows of the touched buckets with ``is_new``.

    ``batch`` is best a written table: its keys are read first, then its rows.
    """
    root = root.rstrip("/")
    aside = f"{root}/_merged/{tag}"
    if _there(spark, f"{aside}.done") is None:
        buckets = count(spark, root)
        own = touched(batch, buckets, eligible)
        merged = merge.upsert(read(spark, root, own), batch, as_of, eligible=eligible, **options)
        merged.withColumn(BUCKET, bucket_of(buckets)).write.mode("overwrite").parquet(aside)
        spark.range(1).write.mode("overwrite").parquet(f"{aside}.done")  # only now is what lies aside complete
    merged = spark.read.parquet(aside)
    _replace(merged.drop("is_new"), root)
    return merged.drop(BUCKET)
