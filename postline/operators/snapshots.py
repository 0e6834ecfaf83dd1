"""Versioned Parquet snapshots: atomic replace, change detection, retention.

A table is a folder of versions ``v=<n>/`` plus a one-line ``CURRENT`` file
naming the live version.  Writers write a new version, then swap the pointer
(the file-system analogue of "write temp, then rename"), so a reader never
sees a half-written table and a table is never overwritten while read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active SparkSession")
    return spark


def _hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) for any Hadoop-supported location (local, HDFS, S3A, ...)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_pointer(path: str, spark: SparkSession | None = None) -> str | None:
    """First line of a small text file, or None when it does not exist."""
    spark = spark or _active()
    jvm = spark._jvm
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return line.strip() if line is not None else None


def write_pointer(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Replace a small text file atomically: write a temporary file, then rename
    it over the old one (``FileContext.rename`` with OVERWRITE)."""
    import uuid

    spark = spark or _active()
    jvm = spark._jvm
    fs, p = _hadoop(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    conf = spark._jsc.hadoopConfiguration()
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    opts = spark.sparkContext._gateway.new_array(rename, 1)
    opts[0] = rename.OVERWRITE
    fc.rename(tmp, p, opts)


def current_version(root: str, spark: SparkSession | None = None) -> int | None:
    text = read_pointer(f"{root.rstrip('/')}/{POINTER}", spark)
    return int(text) if text else None


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    v = current_version(root, spark)
    if v is None:
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/v={v}")


def content_checksum(df: DataFrame, exclude=()) -> DataFrame:
    """Order-insensitive checksum: row count and XOR of 64-bit row hashes."""
    cols = [F.col(c) for c in df.columns if c not in exclude]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(F.xxhash64(F.struct(*cols))), F.lit(0)).alias("checksum"),
        F.coalesce(F.sum(F.xxhash64(F.struct(*cols)) % F.lit(1 << 31)), F.lit(0)).alias("checksum2"),
    )


def snapshot_changed(new: DataFrame, old: DataFrame | None, exclude=()) -> bool:
    if old is None:
        return True
    a = content_checksum(new, exclude).first()
    b = content_checksum(old, exclude).first()
    return tuple(a) != tuple(b)


def write_snapshot(df: DataFrame, root: str, only_if_changed: bool = True, exclude=()) -> int | None:
    """Write a new version and swap the pointer; returns the live version.

    With ``only_if_changed`` an unchanged table (order-insensitive checksum,
    ``exclude`` columns ignored) keeps the current version.
    """
    spark = df.sparkSession
    root = root.rstrip("/")
    cur = current_version(root, spark)
    version = (cur or 0) + 1
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/v={version}")  # evaluated once; compared as written
    if only_if_changed and cur is not None:
        old, new = (spark.read.parquet(f"{root}/v={v}") for v in (cur, version))
        if set(old.columns) == set(new.columns) and not snapshot_changed(new.select(*old.columns), old, exclude):
            delete_path(f"{root}/v={version}", spark)
            return cur
    write_pointer(f"{root}/{POINTER}", str(version), spark)
    return version


def delete_path(path: str, spark: SparkSession | None = None) -> bool:
    """Delete a file or folder, if it is there."""
    fs, p = _hadoop(spark or _active(), path)
    return bool(fs.delete(p, True))


def children(path: str, spark: SparkSession | None = None) -> list[str]:
    """Names in a folder (a few: versions, not data files)."""
    fs, p = _hadoop(spark or _active(), path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def expire_versions(root: str, keep: int, spark: SparkSession | None = None) -> list[int]:
    """Delete all versions but the newest ``keep`` (the live one always stays); returns those deleted."""
    root = root.rstrip("/")
    live = current_version(root, spark)
    versions = sorted(int(n[2:]) for n in children(root, spark) if n.startswith("v=") and n[2:].isdigit())
    old = [v for v in versions[: max(len(versions) - max(keep, 1), 0)] if v != live]
    return [v for v in old if delete_path(f"{root}/v={v}", spark)]


def publish_feed(feed: DataFrame, manifest: DataFrame, root: str) -> str:
    """Publish the feed in a folder of its own and swap the pointer; an unchanged feed keeps the folder that is live.

    The folder's name is the feed's checksum, so a changed feed never overwrites what readers see, and publishing
    again after a failure writes the same folder. The folder before stays for readers that have opened it; older ones go.
    """
    spark = feed.sparkSession
    root = root.rstrip("/")
    aside = f"{root}/_next"
    feed.write.mode("overwrite").parquet(aside)  # evaluated once
    rows = spark.read.parquet(aside)
    sums = content_checksum(rows).first()
    name = f"{sums.rows}-{sums.checksum & (2**64 - 1):016x}-{sums.checksum2 & (2**64 - 1):016x}"
    live = read_pointer(f"{root}/{POINTER}", spark)
    if name != live:
        rows.write.mode("overwrite").json(f"{root}/{name}/jobs")
        manifest.write.mode("overwrite").json(f"{root}/{name}/manifest")
        write_pointer(f"{root}/{POINTER}", name, spark)
        for other in children(root, spark):
            if other not in (name, live, POINTER, "_next") and "-" in other:
                delete_path(f"{root}/{other}", spark)
    delete_path(aside, spark)
    return name


def expired_snapshots(manifest: DataFrame, keep: int, version: str = "version") -> DataFrame:
    """Versions to expire: all but the newest ``keep`` (a distributed top-k keeps them)."""
    newest = manifest.orderBy(F.col(version).desc()).limit(keep).select(version)
    return manifest.join(F.broadcast(newest), version, "left_anti")


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
