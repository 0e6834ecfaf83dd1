"""Exploration of the public feed: keys, display fields, search, sort,
review buckets, review actions, summary and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_REASON, NO_LOCATION, STRONG_SCORE, UI_DEFAULT_MIN_SCORE, UNKNOWN_DATE
from ..functions.identity import job_key, legacy_key
from ..functions.urls import safe_link
from .eligibility import is_us_location
from .exports import zero_filled
from .ordering import with_global_rank


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def with_keys(feed: DataFrame) -> DataFrame:
    return feed.withColumn("job_key", job_key("job_hash", "title", "company", "location", "url")).withColumn(
        "legacy_key", legacy_key("title", "company", "location", "url")
    )


def display_date(c: str) -> Column:
    v = _s(c)
    ts = F.try_to_timestamp(v)
    return F.when(v == "", F.lit(UNKNOWN_DATE)).when(ts.isNull(), v).otherwise(F.date_format(ts, "MMM d, yyyy"))


def display_rows(feed: DataFrame) -> DataFrame:
    def nz(c: str, default: str) -> Column:
        return F.when(_s(c) != "", _s(c)).otherwise(F.lit(default))

    return feed.select(
        "job_hash",
        nz("location", NO_LOCATION).alias("location_text"),
        nz("status", "New").alias("status_text"),
        nz("match_reason", DEFAULT_REASON).alias("reason_text"),
        F.concat(F.lit("Found "), display_date("date_found")).alias("found_text"),
        (F.col("match_score") >= STRONG_SCORE).alias("high"),
        safe_link("url").alias("link"),
    )


def search_feed(
    feed: DataFrame,
    query: str = "",
    company: str = "",
    status: str = "",
    location: str = "",
    minimum_score: int = UI_DEFAULT_MIN_SCORE,
) -> DataFrame:
    """Free-text search (lower-cased substring over five fields), facet
    equality, the browser's US filter and the score threshold."""
    q = query.strip().lower()
    out = feed.filter(F.col("match_score") >= minimum_score)
    if q:
        hay = F.lower(F.concat_ws(" ", _s("title"), _s("company"), _s("location"), _s("match_reason"), _s("employment_type")))
        out = out.filter(F.contains(hay, F.lit(q)))
    if company:
        out = out.filter(F.col("company") == company)
    if status:
        out = out.filter(F.col("status") == status)
    if location:
        out = out.filter(F.lit(location == "us") & is_us_location("location", mode="names_only"))
    return out


SORT_MODES = ("score", "newest", "company", "title")


def sort_keys(mode: str) -> list[Column]:
    """Mode keys, then the stored review order as the stable tiebreak."""
    def unicode(c: str) -> Column:
        return F.collate(_s(c), "UNICODE")

    if mode == "newest":
        keys = [_s("date_found").desc()]
    elif mode == "company":
        keys = [unicode("company").asc()]
    elif mode == "title":
        keys = [unicode("title").asc()]
    else:
        keys = [F.col("match_score").desc(), _s("date_found").desc()]
    return keys + [F.col("feed_pos").asc()]


def sorted_feed(feed: DataFrame, mode: str = "score") -> DataFrame:
    """Feed in a browser sort mode with its position (``feed_pos`` is the stored order)."""
    if "entity_key" not in feed.columns:
        return with_global_rank(feed, sort_keys(mode), "sort_pos")
    reads = {"newest": ("date_found",), "company": ("company",), "title": ("title",)}.get(mode, ("match_score", "date_found"))
    return with_global_rank(feed, sort_keys(mode), "sort_pos", key="entity_key", reads=(*reads, "feed_pos"))


def migrate_actions(actions: DataFrame, feed: DataFrame) -> DataFrame:
    """Saved actions re-keyed to the hash key; 'applyed' becomes 'applied'.

    A legacy-keyed action moves to the feed row's hash key only if that key
    has no action of its own; the first feed row wins when two share a legacy key.
    """
    fixed = actions.withColumn(
        "action", F.when(F.col("action") == "applyed", F.lit("applied")).otherwise(F.col("action"))
    )
    keyed = with_keys(feed).filter((_s("job_hash") != "") & (F.col("legacy_key") != F.col("job_hash")))
    first = keyed.groupBy("legacy_key").agg(F.min_by("job_hash", "feed_pos").alias("primary"))
    have = fixed.select(F.col("job_key").alias("primary")).distinct().withColumn("_taken", F.lit(True))
    j = fixed.join(first, fixed.job_key == first.legacy_key, "left").join(have, "primary", "left")
    move = F.col("primary").isNotNull() & F.col("_taken").isNull()
    return j.select(
        F.when(move, F.col("primary")).otherwise(F.col("job_key")).alias("job_key"), "action"
    )


def apply_actions(log: DataFrame) -> DataFrame:
    """Action log -> current action per key (last wins; 'review' removes the entry)."""
    last = log.groupBy("job_key").agg(F.max_by("action", "seq").alias("action"))
    return last.filter(F.col("action") != "review")


def review_buckets(feed: DataFrame, actions: DataFrame) -> DataFrame:
    """Each feed row's bucket: applied, not-fit, else review."""
    keyed = with_keys(feed)
    j = keyed.join(actions.select("job_key", "action"), "job_key", "left")
    bucket = (
        F.when(F.col("action").isin("applied", "applyed"), F.lit("applied"))
        .when(F.col("action") == "not-fit", F.lit("not-fit"))
        .otherwise(F.lit("review"))
    )
    return j.withColumn("bucket", bucket)


def bucket_counts(buckets: DataFrame) -> DataFrame:
    """Rows per bucket (0 for empty ones) and in total, from one scan."""
    return zero_filled(buckets, "bucket", ("review", "applied", "not-fit"), "total")


def feed_summary(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("match_score") >= STRONG_SCORE).alias("strong"),
        F.count_distinct(F.when(_s("company") != "", F.col("company"))).alias("companies"),
        F.count_if(F.contains(F.lower(_s("location")), F.lit("remote"))).alias("remote"),
        F.greatest(F.lit(0), F.coalesce(F.max("match_score"), F.lit(0))).alias("top_score"),
    )


def facets(feed: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in locale order (UNICODE collation)."""
    vals = feed.select(F.col(column).alias("value")).filter(_s("value") != "").distinct()
    ranked = with_global_rank(vals, [F.collate(F.col("value"), "UNICODE").asc(), F.col("value").asc()], "pos")
    return ranked.withColumn("facet", F.lit(column))
