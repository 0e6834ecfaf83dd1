"""Inputs derived from the driver's tables.

The driver tables hold no job postings, so each input is a deterministic
projection of them (the same definitions are written in SQL for the DuckDB
oracle in ``plans.oracle``).  Every view covers its whole table.

* ``postings``  documents LEFT JOIN pages: first line = title, text =
  description, source = company; location, type, salary, date from fixed
  lists indexed by ``doc_id``.
* ``sightings`` events as observations of an entity (event_type:user_id).
* ``edits``     labels as human edits of the stored rows.
* ``requests``  events as an outgoing request log.
* ``actions``   conversation turns as review actions on the feed.
* ``sources``   the distinct document sources as a source dimension.
* ``runs``      events per hour as run-log rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import broadcast_if_light
from ..operators.scoring import Rule

# fixed values: fixture lists indexed by doc_id modulo their length
LOCATIONS = (
    "Seattle, WA",
    "Remote",
    "Paris, France",
    "Remote - United States",
    "Austin",
    "New York, NY",
    "Berlin",
    "Remote - U.S.",
    "Portland, Oregon",
    "",
)
EMPLOYMENT_TYPES = ("Full-time", "Intern", "Co-op", "Contract", "", "Full-time", "Full-time")
SOURCE_TYPES = ("lever", "ashby", "greenhouse", "html")
SALARIES = ("120000 - 180000 USD", "", "0 - 50000", "USD", "95000")
DATE_TEXTS = ("2024-03-05T10:20:30Z", "2024-03-05 10:20:30", "2024-03-05", "20240102", "soon", "")
EPOCH_BASE = 1_700_000_000
DIMENSION_TYPES = ("lever", "ashby", "greenhouse", "html", "Lever", "workday")

# fixed values: fixture keyword rules (words that occur in the documents)
FIXTURE_RULES = (
    Rule("title_boost", 0, "the", 30.0),
    Rule("title_boost", 1, "que", 25.0),
    Rule("title_boost", 2, "und", 20.0),
    Rule("include", 0, "that", 12.0),
    Rule("include", 1, "of", 10.0),
    Rule("include", 2, "la", 12.0),
    Rule("include", 3, "sch", 8.0),
    Rule("include", 4, "with", 7.5),
    Rule("exclude", 0, "Licensed under the Apache License, Version 2.0.", 40.0),
    Rule("exclude", 1, "der", 15.0),
    Rule("exclude", 2, "Intern", 100.0),
)

AS_OF_FIRST = "2026-06-08 09:00:00"
AS_OF_SECOND = "2026-06-08 12:00:00"
AS_OF_EDITS = "2026-06-08 10:00:00"


#: A scan is dealt anew if one of its partitions has so many times the rows of an even share for each core.
UNEVEN = 3


def balanced(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan over the cores when it yields fewer partitions than that.

    A parquet file with one row group is one partition; the text work on it
    (regexes over whole documents) would run in one task.  Large inputs
    already have many partitions and are left alone (no extra shuffle), unless few
    of these hold most rows (a split without the start of a row group has none).
    With ``key`` the rows are hash-partitioned on it, so a following join on
    that key reuses the partitioning instead of shuffling again.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key) if key else df.repartition(target)
    held = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    held = held.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (held.most or 0) * target > UNEVEN * (held.rows or 0):
        return df.repartition(target, key) if key else df.repartition(target)
    return df


# tables whose rows carry whole texts (regex work per row), with the key they are joined on;
# the other tables carry short rows and are not spread (that would only add a shuffle)
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Raw postings; ``shift`` rotates the location list (a later sighting)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"))
    # short rows: where they are proven to be light, the texts are joined where they are read
    j = d.join(broadcast_if_light(p), "doc_id", "left")
    i = F.col("doc_id")
    epoch = F.lit(EPOCH_BASE) + i * 3600
    date_text = (
        F.when(i % 8 == 0, epoch.cast("string"))
        .when(i % 8 == 1, (epoch * 1000 + 123).cast("string"))
        .otherwise(_pick(DATE_TEXTS, i % 8 - 2))
    )
    return j.select(
        i.alias("seq"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("company"),
        _pick(LOCATIONS, i + shift).alias("location"),
        F.coalesce(F.col("page_url"), F.lit("")).alias("url"),
        F.col("source").alias("source_name"),
        _pick(SOURCE_TYPES, i).alias("source_type"),
        F.col("text").alias("description"),
        _pick(SALARIES, i).alias("salary"),
        _pick(EMPLOYMENT_TYPES, i).alias("employment_type"),
        date_text.alias("date_posted"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")).alias("entity"),
        F.col("ts").cast("timestamp").alias("run_time"),
        F.col("value").alias("score"),
    )


def edits(spark: SparkSession, sf_dir: str, normalized: DataFrame) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("raw_url"))
    n = normalized.select(F.col("seq").alias("doc_id"), "job_hash")
    j = lab.join(n, "doc_id", "left").join(pages, "doc_id", "left")
    i = F.col("doc_id")
    status = (
        F.when(F.col("toxic") == 1, F.lit("Rejected"))
        .when(F.col("quality") == 1, F.lit("Interested"))
        .when(i % 5 == 0, F.lit("Maybe"))
        .when(i % 5 == 1, F.lit(""))
        .otherwise(F.lit("Applied"))
    )
    return j.select(
        (i * 4 + F.col("quality") * 2 + F.col("toxic")).cast("long").alias("seq"),
        i.alias("doc_id"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.coalesce(F.col("job_hash"), F.lit(""))).alias("job_hash"),
        F.coalesce(F.col("raw_url"), F.lit("")).alias("url"),
        status.alias("status"),
        F.when(i % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit(" t"), F.col("toxic").cast("string")))
        .alias("notes"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    code = F.when(
        F.col("event_type") == "error",
        F.when(u % 3 == 0, F.lit(429)).when(u % 3 == 1, F.lit(403)).otherwise(F.lit(500)),
    ).otherwise(F.lit(200))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("https://"), F.col("event_type"), F.lit(".Example.com/jobs/"), u.cast("string")).alias("url"),
        (u % 2 == 0).alias("api"),
        code.alias("status_code"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def actions(spark: SparkSession, sf_dir: str, feed: DataFrame) -> DataFrame:
    """Review actions keyed like the browser keys the feed rows."""
    conv = table(spark, sf_dir, "conversations")
    f = feed.select(
        F.col("seq").alias("conv_id"),
        "job_hash",
        F.concat_ws("||", "title", "company", "location", "url").alias("legacy"),
    )
    j = conv.join(f, "conv_id", "inner")
    t = F.col("turn")
    action = (
        F.when(F.col("role") == "user", F.when(t % 4 == 0, F.lit("applyed")).otherwise(F.lit("applied")))
        .when(F.col("role") == "assistant", F.lit("not-fit"))
        .otherwise(F.lit("review"))
    )
    return j.select(
        (F.col("conv_id") * 1000 + t).alias("seq"),
        F.when(t % 3 == 0, F.col("legacy")).otherwise(F.col("job_hash")).alias("job_key"),
        action.alias("action"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    idx = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int")
    typ = _pick(DIMENSION_TYPES, idx)
    low = F.lower(typ)
    return d.select(
        idx.alias("pos"),
        F.col("source").alias("name"),
        typ.alias("type"),
        (idx % 7 != 6).alias("enabled"),
        F.when(idx % 3 == 0, F.lit(None).cast("string")).otherwise(F.upper("source")).alias("company"),
        F.when(low == "html", F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/careers")))
        .otherwise(F.lit("")).alias("url"),
        F.when(low == "lever", F.col("source")).otherwise(F.lit(None).cast("string")).alias("company_slug"),
        F.when(low.isin("ashby", "greenhouse"), F.concat(F.col("source"), F.lit("-board")))
        .otherwise(F.lit(None).cast("string")).alias("board_token"),
        F.concat(F.lit("Fixture source "), F.col("source")).alias("notes"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    n_err = F.count_if(F.col("event_type") == "error")
    return (
        e.groupBy(hour.alias("run_time"))
        .agg(
            F.count_distinct("event_type").cast("int").alias("sources_checked"),
            F.count(F.lit(1)).alias("jobs_found"),
            F.count_if(F.col("event_type") == "signup").alias("new_jobs_added"),
            n_err.alias("_err"),
            F.max("value").alias("duration_seconds"),
        )
        .withColumn(
            "errors",
            F.when(F.col("_err") > 0, F.concat(F.col("_err").cast("string"), F.lit(" errors"))).otherwise(F.lit("")),
        )
        .drop("_err")
    )
