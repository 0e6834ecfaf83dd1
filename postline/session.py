"""Session helpers: local sessions for tests and benches, checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def _driver_memory(default_gb: int = 8) -> str:
    """Driver heap for local runs: the override, else at most 60 % of physical memory."""
    if os.environ.get("POSTLINE_DRIVER_MEMORY"):
        return os.environ["POSTLINE_DRIVER_MEMORY"]
    try:
        total_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
        return f"{max(1, min(default_gb, int(total_gb * 0.6)))}g"
    except (ValueError, OSError, AttributeError):
        return f"{default_gb}g"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "postline") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", _driver_memory())
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A folder of our own is made only when the session names none (local
    tests); on a cluster the setting is expected to point at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="postline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for derived tables."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, "work", name)
    return path


def cluster_conf(input_bytes: int, total_cores: int, executor_memory_gb: float = 16.0, cores_per_executor: int = 4) -> dict:
    """Spark settings sized for a run over ``input_bytes`` of input on ``total_cores`` cores.

    * scan splits of input / (3 x cores), kept within 32..256 MB and within a quarter
      of a task's memory share, so every core gets work and no split outgrows memory;
    * shuffle partitions sized for about 200 MB each (text rows expand in the
      merge), at least 2 x cores, so AQE can coalesce down but never has to split up;
    * AQE on, with the skew-join split for partitions 5x the median and over 512 MB.
    """
    mem_per_task = executor_memory_gb * (1 << 30) * 0.6 / max(1, cores_per_executor)
    target = input_bytes // max(1, 3 * total_cores)
    split = int(min(max(32 << 20, min(256 << 20, target)), mem_per_task / 4))
    shuffle = max(2 * total_cores, int(input_bytes / (200 << 20)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }
