"""Structured Streaming forms of the run-over-run state.

* ``stream_ingest`` (incremental ingest): a file-source stream of landed
  payloads; every micro-batch goes through the batch path (normalise,
  eligibility, score, collapse) and is merged into the stored table, which
  is written as a new snapshot version.  The batch time comes from the
  micro-batch id, not the wall clock, so a re-delivered batch gives the same
  table.
* ``running_first_last_seen``: first / last sighting and count per entity,
  a streaming aggregation in ``update`` mode (state grows with the number of
  entities, as nothing expires in the workflow).
"""

from __future__ import annotations

import os
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, snapshots
from ..operators.scoring import Rule
from ..sources import payloads


def stream_ingest(
    spark: SparkSession,
    landed_lever: str,
    table_root: str,
    checkpoint: str,
    rules: list[Rule] | None,
    start: str = "2026-06-08 09:00:00",
    files_per_batch: int = 16,
    merge_every: int | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Run an ``availableNow`` stream over landed Lever payloads; return the final table.

    Micro-batches are staged (flagged rows + batch time, written under the table folder;
    cost grows with the batch, not the table) and merged every ``merge_every`` batches
    (None: each) and at the end in one time-aware merge, which equals merging them one
    after the other. A merge writes a new snapshot.

    Rows are those of the batch reader, company and raw payload included (``sources`` has the
    configured ones); payloads and postings that can't be read go to ``_quarantine``.
    """
    stream = (
        spark.readStream.schema("value string, source_name string")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", False)
        .text(landed_lever)
    )
    t0 = datetime.fromisoformat(start)
    root = table_root.rstrip("/")
    staging = f"{root}/_staging"

    def batch_time(batch_id: int) -> str:
        return (t0 + timedelta(minutes=batch_id)).strftime("%Y-%m-%d %H:%M:%S")

    def current() -> DataFrame:
        stored = snapshots.read_current(spark, root)
        return stored if stored is not None else merge.empty_store(spark)

    def merge_staged() -> None:
        done = snapshots.read_pointer(f"{root}/MERGED", spark)
        last = int(done) if done else -1
        try:
            staged = spark.read.parquet(staging).filter(F.col("batch_id") > last)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing has been staged yet
        top = staged.agg(F.max("batch_id")).first()[0]
        if top is None:
            return
        staged = staged.withColumn("_ord", F.struct("batch_id", "seq"))
        new = merge.upsert(current(), staged, None, eligible="eligible", order="_ord", time="batch_time")
        snapshots.write_snapshot(new.drop("is_new"), root, only_if_changed=False)
        snapshots.write_pointer(f"{root}/MERGED", str(top), spark)

    def _in_order(rows: DataFrame) -> DataFrame:
        """Order within a micro-batch is the posting's creation time; postings without one come first."""
        rows = rows.withColumn("seq", F.coalesce(F.col("date_posted").try_cast("bigint"), F.lit(0).cast("bigint")))
        if sources is None:
            return rows.withColumn("company", F.col("source_name"))
        return payloads.with_company(rows, sources)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch is a static DataFrame: run the batch path on it
        lines = batch.filter(F.trim("value") != "")
        rows = payloads.items(lines, "lever")
        payloads.quarantine_lines(lines, rows, "lever").write.mode("overwrite").parquet(f"{root}/_quarantine/batch_id={batch_id}")
        flagged = merge.flag_batch(_in_order(payloads.lever_rows(rows)), rules)
        # written once: the merge reads keys and rows of what lies there
        staged = flagged.withColumn("batch_time", F.lit(batch_time(batch_id)).cast("timestamp"))
        staged.write.mode("overwrite").parquet(f"{staging}/batch_id={batch_id}")
        if (batch_id + 1) % (merge_every or 1) == 0:
            merge_staged()

    q = (
        stream.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    merge_staged()
    return current()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_first_last_seen(
    spark: SparkSession, events_dir: str, checkpoint: str, file_glob: str = "events.parquet", files_per_batch: int = 1
) -> DataFrame:
    """Streaming first/last seen per entity over the events table; returns the final state.

    A micro-batch takes ``files_per_batch`` files. The state of the entities is carried from batch to batch in
    the RocksDB store, which holds it outside of the heap and checkpoints changes only.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(events_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxFilesPerTrigger", files_per_batch).parquet(events_dir)
    seen = stream.select(
        F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")).alias("entity"),
        F.col("ts").cast("timestamp").alias("run_time"),
    )
    agg = seen.groupBy("entity").agg(
        F.min("run_time").alias("first_seen"), F.max("run_time").alias("last_seen"), F.count(F.lit(1)).alias("sightings")
    )
    out = os.path.join(checkpoint, "updates")

    def append(batch: DataFrame, batch_id: int) -> None:
        # update mode: the rows of entities that changed in this micro-batch
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (
        agg.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", os.path.join(checkpoint, "state"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    # each entity's newest update is its state (values only grow)
    return spark.read.parquet(out).groupBy("entity").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("sightings").alias("sightings")
    )
