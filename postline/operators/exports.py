"""Exports: public feed, review sheets, status counts, summary, run log, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    JOBS_SHEET_COLUMNS,
    PUBLIC_FIELDS,
    RUN_LOG_COLUMNS,
    STATUSES,
    SUMMARY_METRICS,
    WEBSITE_MIN_SCORE,
    WORKBOOK_MIN_SCORE,
)
from ..functions.dates import iso_text, next_slot
from .ordering import broadcast_if_small
from .scoring import Rule

TIMESTAMP_COLUMNS = ("date_found", "last_seen", "created_at", "updated_at")


def _text(df: DataFrame, c: str):
    if c in TIMESTAMP_COLUMNS:
        return F.coalesce(iso_text(c), F.lit("")).alias(c)
    if c == "match_score":
        return F.col(c)
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def public_feed(stored: DataFrame, minimum_score: int = WEBSITE_MIN_SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The privacy whitelist: 15 public columns of rows at or above the threshold
    (``keep`` names extra internal columns to carry along, e.g. a position)."""
    rows = stored.filter(F.col("match_score") >= minimum_score)
    return rows.select(*[_text(rows, c) for c in PUBLIC_FIELDS], *keep)


def jobs_sheet(stored: DataFrame, minimum_score: int = WORKBOOK_MIN_SCORE) -> DataFrame:
    rows = stored.filter(F.col("match_score") >= minimum_score)
    return rows.select(*[_text(rows, c).alias(header) for header, c in JOBS_SHEET_COLUMNS])


def status_counts(stored: DataFrame) -> DataFrame:
    """Count per status, zero-filled over the six statuses, unknown ones kept, plus 'Total'."""
    return zero_filled(stored, "status", STATUSES, "Total")


def zero_filled(rows: DataFrame, column: str, values, total: str) -> DataFrame:
    """(column, count): rows per value with 0 for absent ones of ``values``, and a row named ``total`` with all rows.

    One scan: the grouping sets (column) and () share it, and so they share the partial counts.
    """
    spark = rows.sparkSession
    enum = spark.createDataFrame([(v,) for v in [*values, total]], "_v string")
    sets = rows.groupingSets([[F.col(column)], []], F.col(column)).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_all"))
    counts = sets.select(F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(column)).alias("_c"), (F.col("_all") == 1).alias("_t"), "_n")
    # the total's row is matched by its flag, so that a value of the same name stays apart
    named = enum.withColumn("_f", F.col("_v") == total)
    j = named.join(counts, (F.col("_v") == F.col("_c")) & (F.col("_f") == F.col("_t")), "full_outer")
    return j.select(F.coalesce("_v", "_c").alias(column), F.coalesce("_n", F.lit(0)).cast("long").alias("count"))


def summary_metrics(stored: DataFrame, as_of, slots=()) -> DataFrame:
    """Metric / Value rows: seven counts, last run time, next expected run time."""
    counts = status_counts(stored)
    spark = stored.sparkSession
    labels = spark.createDataFrame(
        [(i, label, key) for i, (label, key) in enumerate(SUMMARY_METRICS)], "pos int, Metric string, status string"
    )
    body = labels.join(counts, "status", "left").select(
        "pos", "Metric", F.coalesce(F.col("count"), F.lit(0)).cast("string").alias("Value")
    )
    ts = F.lit(as_of).cast("timestamp")
    times = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(len(SUMMARY_METRICS)).alias("pos"), F.lit("Last Run Time").alias("Metric"),
                         iso_text(ts).alias("Value")),
                F.struct(F.lit(len(SUMMARY_METRICS) + 1).alias("pos"), F.lit("Next Expected Run Time").alias("Metric"),
                         next_slot(ts, slots).alias("Value")),
            )
        )
    )
    return body.unionByName(times)


def run_log_sheet(runs: DataFrame) -> DataFrame:
    return runs.select(*[F.col(c).alias(h) for h, c in RUN_LOG_COLUMNS])


def recent_run_logs(runs: DataFrame, limit: int = 200, order: str = "run_time") -> DataFrame:
    """Last ``limit`` runs, numbered oldest first (a distributed top-k)."""
    last = runs.orderBy(F.col(order).desc()).limit(limit)
    from pyspark.sql import Window

    w = Window.orderBy(F.col(order).asc())  # at most ``limit`` rows
    return last.withColumn("pos", F.row_number().over(w).cast("long"))


def source_locator(df: DataFrame):
    def ne(c):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) if c in df.columns else F.lit(None)

    return F.coalesce(ne("url"), ne("company_slug"), ne("board_token"), F.lit(""))


def source_status(sources: DataFrame, checks: DataFrame) -> DataFrame:
    """Sources sheet: sources LEFT JOIN latest checks on name (both small dimensions)."""
    c = checks.select(F.col("source_name").alias("name"), "last_checked")
    j = sources.join(broadcast_if_small(c), "name", "left")

    def opt(name: str, default):
        # optional source settings: an absent key reads as the default
        return F.coalesce(F.col(name), F.lit(default)) if name in j.columns else F.lit(default)

    return j.select(
        F.col("name").alias("Source Name"),
        opt("type", "").alias("Source Type"),
        source_locator(j).alias("URL"),
        opt("enabled", False).alias("Enabled"),
        F.coalesce(iso_text("last_checked"), F.lit("")).alias("Last Checked"),
        opt("notes", "").alias("Notes"),
    )


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Keywords sheet: the three rule sections as one relation with a type tag."""
    parts = []
    for section in ("include", "title_boost", "exclude"):
        rows = [(r.keyword, section, float(r.weight), r.pos) for r in rules if r.section == section]
        parts.append(spark.createDataFrame(rows, "Keyword string, Type string, Weight double, pos int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("Notes", F.lit(""))


def feed_manifest(feed: DataFrame, minimum_score: int, generated_at) -> DataFrame:
    """Envelope header of the public feed: generated_at, minimum_score, total."""
    return feed.agg(F.count(F.lit(1)).alias("total")).select(
        iso_text(F.lit(generated_at).cast("timestamp")).alias("generated_at"),
        F.lit(minimum_score).alias("minimum_score"),
        "total",
    )


def feed_envelope(feed: DataFrame, minimum_score: int, generated_at) -> DataFrame:
    """One-row envelope with every row nested (only for small, thresholded feeds:
    ``collect_list`` gathers the whole feed in one task)."""
    return feed.agg(
        F.count(F.lit(1)).alias("total"),
        F.collect_list(F.struct(*[F.col(c) for c in feed.columns])).alias("jobs"),
    ).select(
        iso_text(F.lit(generated_at).cast("timestamp")).alias("generated_at"),
        F.lit(minimum_score).alias("minimum_score"),
        "total",
        "jobs",
    )


ROW_COLUMN = "Row"


def write_jobs_sheet_csv(stored: DataFrame, path: str, minimum_score: int = WORKBOOK_MIN_SCORE) -> None:
    """Review sheet as CSV part files with a header, rows in review order.

    A ``Row`` column carries the sheet position (a distributed rank), so the
    edits read back later keep their order without a single-file write.
    """
    from .ordering import review_order, with_global_rank

    rows = stored.filter(F.col("match_score") >= minimum_score)
    ranked = with_global_rank(rows, review_order(), ROW_COLUMN)
    sheet = ranked.select(*[_text(ranked, c).alias(header) for header, c in JOBS_SHEET_COLUMNS], ROW_COLUMN)
    sheet.write.mode("overwrite").option("header", True).csv(path)


def write_review_export(
    out_dir: str,
    stored: DataFrame,
    sources: DataFrame,
    checks: DataFrame,
    rules: list[Rule],
    runs: DataFrame,
    as_of,
    slots=(),
    minimum_score: int = WORKBOOK_MIN_SCORE,
    run_log_limit: int = 200,
) -> dict[str, str]:
    """The five review relations as CSV folders (header row) under ``out_dir``:
    Jobs (review order, with a Row column), Sources, Keywords, Summary, Run_Log."""
    spark = stored.sparkSession
    base = out_dir.rstrip("/")
    paths = {name: f"{base}/{name}" for name in ("Jobs", "Sources", "Keywords", "Summary", "Run_Log")}
    write_jobs_sheet_csv(stored, paths["Jobs"], minimum_score)
    frames = {
        "Sources": source_status(sources, checks),
        "Keywords": rules_table(spark, rules).drop("pos"),
        "Summary": summary_metrics(stored, as_of, slots).orderBy("pos").drop("pos"),
        "Run_Log": run_log_sheet(
            recent_run_logs(runs, run_log_limit).orderBy("pos").withColumn("run_time", iso_text("run_time"))
        ),
    }
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(paths[name])
    return paths
