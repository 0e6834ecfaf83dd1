"""One complete run of the workflow as a composition of the operators.

    edits -> dispatch sources -> read payloads (+ quarantine) -> normalise /
    flag / score -> collapse + merge -> source checks + run log -> purges ->
    new stored snapshot -> exports

Everything is a DataFrame plan except three small driver-side values: the
source dimension (size-checked), the rule set (size-checked) and the run
statistics (scalars).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLEARANCE_EXCLUSION_PHRASE, EXPORT_CONTROL_PHRASE, SNAPSHOTS_KEPT, WEBSITE_MIN_SCORE, WORKBOOK_MIN_SCORE
from ..operators import exports as P
from ..operators import merge
from ..operators import runs as U
from ..operators import snapshots as K
from ..operators.eligibility import with_verdict
from ..operators.ordering import broadcast_if_small
from ..operators.scoring import Rule
from ..sources import payloads as S



@dataclass
class RunResult:
    store: DataFrame  # the new stored table (as written)
    version: int | None  # snapshot version now current
    run_log: DataFrame  # one row
    checks: DataFrame  # latest check per source
    feed: DataFrame  # public feed rows
    jobs_sheet: DataFrame  # review sheet rows


def read_sources(spark: SparkSession, sources: DataFrame, landed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Raw postings of the enabled sources with a reader, and error rows (unsupported
    type or malformed payload) per source."""
    enabled = U.enabled_sources(sources)
    frames = []
    errors = [U.unsupported_sources(sources).select("name", "error")]
    typed = enabled.select(F.col("name").alias("source_name"), F.lower(F.coalesce(F.col("type"), F.lit(""))).alias("_kind"))
    for kind, reader in S.READERS.items():
        path = landed.get(kind)
        if not path:
            continue
        # dispatch: a source is read only by the reader of its configured type
        mine = broadcast_if_small(typed.filter(F.col("_kind") == kind).select("source_name"))
        frames.append(reader(spark, path).join(mine, "source_name", "left_semi"))
        errors.append(S.quarantine(spark, path, kind).select(F.col("source_name").alias("name"), "error"))
    raw = reduce(DataFrame.unionByName, frames) if frames else None
    dims = broadcast_if_small(enabled.select(F.col("name").alias("source_name"), "pos"))
    raw = raw.join(dims, "source_name", "inner")
    # run order: source position, then payload order inside the source (a struct key)
    raw = raw.withColumn("seq", F.struct(F.col("pos").alias("source_pos"), F.col("seq").alias("row"))).drop("pos")
    err = reduce(DataFrame.unionByName, errors)
    err = err.join(broadcast_if_small(enabled.select("name", "pos")), "name", "inner")
    # one message per source (the first by text), as a source fails once per run
    err = err.groupBy("name", "pos").agg(F.min("error").alias("error"))
    return S.with_company(raw, sources), err


def _stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate once and read it back (cuts the lineage; later
    steps do not re-run the text work)."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def run(
    spark: SparkSession,
    store_root: str,
    sources: DataFrame,
    landed: dict[str, str],
    rules: list[Rule] | None,
    as_of: str,
    edits: DataFrame | None = None,
    old_checks: DataFrame | None = None,
    purge_phrases=(EXPORT_CONTROL_PHRASE, CLEARANCE_EXCLUSION_PHRASE),
    export_dir: str | None = None,
    slots=(),
) -> RunResult:
    """One run.  The run-log row is appended to ``<store_root>/_run_log``; with
    ``export_dir`` the public feed (JSON Lines + manifest) and the five review
    relations (CSV) are written there."""
    import time

    started = time.monotonic()
    stored = K.read_current(spark, store_root)
    if stored is None:
        stored = merge.empty_store(spark)
    if edits is not None:
        stored = merge.apply_edits(stored, edits, as_of).drop("edited")

    raw, errors = read_sources(spark, sources, landed)
    staging = f"{store_root}/_staging/{as_of.replace(' ', 'T').replace(':', '')}"
    raw, seen_raw = U.observed(raw, "raw", found=F.count(F.lit(1)))
    errors = _stage(errors, f"{staging}/errors")  # a row for each source that failed; the payloads are tested once
    # every posting as read is a row of this table: it is counted while it is written, and by source below
    flagged = _stage(with_verdict(merge.flag_batch(raw, rules), "eligible"), f"{staging}/flagged")
    merged, seen_merged = U.observed(merge.upsert(stored, flagged, as_of, eligible="eligible"), "merged", new=F.count_if(F.col("is_new")))
    merged = _stage(merged, f"{staging}/merged")

    checks_now = U.source_results(sources, flagged, errors).select(
        F.col("name").alias("source_name"),
        F.lit(as_of).cast("timestamp").alias("last_checked"),
        "last_result",
        F.lit(1).cast("long").alias("seq"),
    )
    checks = checks_now if old_checks is None else merge.latest_checks(old_checks, checks_now)
    checks = _stage(checks, f"{store_root.rstrip('/')}/_checks/{staging.rsplit('/', 1)[1]}")
    K.delete_path(f"{staging}/flagged", spark)  # merged and counted
    # both counts were taken while the tables were written
    stats = U.run_record(sources, errors, F.lit(seen_raw.get["found"]), F.lit(seen_merged.get["new"]))
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # one row
    run_log = stats.select(
        F.lit(as_of).cast("timestamp").alias("run_time"),
        "*",
        F.lit(round(time.monotonic() - started, 2)).alias("duration_seconds"),
    )
    K.append_run_log(run_log.drop("run_status"), f"{store_root.rstrip('/')}/_run_log")

    store = merged.drop("is_new")
    for phrase in purge_phrases:
        store = merge.phrase_purge(store, phrase)
    store = merge.eligibility_purge(store)
    version = K.write_snapshot(store, store_root)
    K.expire_versions(store_root, SNAPSHOTS_KEPT, spark)
    K.delete_path(staging, spark)  # nothing reads it any more
    written = K.read_current(spark, store_root)
    feed = P.public_feed(written, WEBSITE_MIN_SCORE)
    if export_dir:
        from ..operators.scoring import default_rules

        out = export_dir.rstrip("/")
        K.publish_feed(feed, P.feed_manifest(feed, WEBSITE_MIN_SCORE, as_of), f"{out}/feed")
        runs = spark.read.parquet(f"{store_root.rstrip('/')}/_run_log")
        P.write_review_export(f"{out}/review", written, sources, checks, rules or default_rules(), runs, as_of, slots)
    return RunResult(
        store=written,
        version=version,
        run_log=run_log,
        checks=checks,
        feed=feed,
        jobs_sheet=P.jobs_sheet(written, WORKBOOK_MIN_SCORE),
    )
