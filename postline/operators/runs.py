"""Run records: per-source results, run statistics, change counts, skip audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import SUPPORTED_SOURCE_TYPES
from .eligibility import skip_reason


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce(F.col("enabled"), F.lit(False)))


def unsupported_sources(sources: DataFrame) -> DataFrame:
    """Enabled sources whose case-folded type has no reader, with the error text."""
    spark = sources.sparkSession
    types = spark.createDataFrame([(t,) for t in SUPPORTED_SOURCE_TYPES], "ftype string")
    s = enabled_sources(sources).withColumn("ftype", F.lower(F.coalesce(F.col("type"), F.lit(""))))
    bad = s.join(F.broadcast(types), "ftype", "left_anti")  # the fixed list of supported types
    return bad.select(
        "name",
        "type",
        F.concat(F.col("name"), F.lit(": ValueError: Unsupported source type: "), F.col("ftype")).alias("error"),
    )


def source_results(sources: DataFrame, fetched: DataFrame, errors: DataFrame) -> DataFrame:
    """Result text per enabled source: 'Success: N jobs' or the error message.

    ``fetched`` has one row per fetched posting with ``source_name``;
    ``errors`` has (name, error).  N counts fetched rows, before eligibility.
    """
    counts = fetched.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("fetched"))
    s = enabled_sources(sources).select("name")
    j = s.join(counts, "name", "left").join(errors.select("name", "error"), "name", "left")
    n = F.coalesce(F.col("fetched"), F.lit(0))
    result = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(
        F.concat(F.lit("Success: "), n.cast("string"), F.lit(" jobs"))
    )
    return j.select("name", n.alias("fetched"), result.alias("last_result"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df and an observation of it: its metrics are there once df has been written, without a scan of their own."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def run_record(sources: DataFrame, errors: DataFrame, found: Column, new: Column) -> DataFrame:
    """One row: sources checked, jobs found, new jobs, errors (newline-joined), status 0/1.

    The counts come as columns (numbers, or aggregates of a one-row table); sources and errors are dimensions, an
    error at most for each source, and are read once each.
    """
    told = errors.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "error"))), lambda e: e["error"]), "\n").alias("errors"),
        F.count(F.lit(1)).alias("n"),
    )
    checked = enabled_sources(sources).agg(F.count(F.lit(1)).cast("int").alias("sources_checked"))
    one = checked.crossJoin(told)  # one row each
    return one.select(
        "sources_checked", found.cast("long").alias("jobs_found"), new.cast("long").alias("new_jobs_added"), "errors", F.when(F.col("n") > 0, 1).otherwise(0).alias("run_status")
    )


def run_stats(sources: DataFrame, fetched: DataFrame, errors: DataFrame, upserted: DataFrame) -> DataFrame:
    """``run_record`` of a run whose tables aren't written: both are read once, within the same plan."""
    counts = fetched.agg(F.count(F.lit(1)).alias("_found")).crossJoin(upserted.agg(F.count_if(F.col("is_new")).alias("_new")))
    row = run_record(sources, errors, F.lit(0), F.lit(0)).drop("jobs_found", "new_jobs_added").crossJoin(counts)  # one row each
    return row.select(
        "sources_checked", F.col("_found").cast("long").alias("jobs_found"), F.col("_new").cast("long").alias("new_jobs_added"), "errors", "run_status"
    )


def skipped_postings(normalized: DataFrame) -> DataFrame:
    return skip_reason(normalized).select("seq", "title", "company", "location", "reason")
