from pyspark.sql import functions as F

from postline.constants import PUBLIC_FIELDS
from postline.operators import explore as X
from postline.operators import exports as P
from postline.operators import merge
from tests.conftest import frame


def _store(spark):
    """One stored posting that a reviewer has marked."""
    rows = [dict(seq=5, title="Shader Artist", company="North", location="Oslo", url="https://h.io/j/5", source_name="board",
                 source_type="ashby", description="Internal text", salary="90k", employment_type="Permanent")]
    scored = merge.normalize_postings(frame(spark, rows)).withColumns({"match_score": F.lit(61), "match_reason": F.lit("Matched shader")})
    first = merge.upsert(merge.empty_store(spark), scored, "2026-06-08 09:00:00").drop("is_new")
    marked = first.select(F.lit(1).cast("long").alias("seq"), "job_hash", F.lit("").alias("url"), F.lit("Interested").alias("status"), F.lit("call back").alias("notes"))
    return merge.apply_edits(first, marked, "2026-06-08 10:00:00").drop("edited")


def test_feed_has_the_public_columns_and_no_others(spark):
    store = _store(spark)
    feed = P.public_feed(store, 35)
    assert tuple(feed.columns) == PUBLIC_FIELDS
    assert not (set(store.columns) - set(PUBLIC_FIELDS)) & set(feed.columns)
    text = " ".join(str(v) for v in feed.first())
    assert "Internal text" not in text and "call back" not in text
    assert feed.first().asDict().items() >= {"status": "Interested", "match_score": 61, "salary": "90k", "date_found": "2026-06-08T09:00:00+00:00"}.items()
    assert P.public_feed(store, 62).count() == 0


def test_status_counts_zero_filled_with_total(spark):
    got = {r.status: r["count"] for r in P.status_counts(_store(spark)).collect()}
    assert got == {"New": 0, "Interested": 1, "Applied": 0, "Not Match": 0, "Rejected": 0, "Archived": 0, "Total": 1}


def test_summary_and_next_slot(spark):
    rows = P.summary_metrics(_store(spark), "2026-06-08 13:30:00", ["09:00", "12:00", "16:00", "20:00", "bad", "25:00"]).collect()
    got = {r.Metric: r.Value for r in rows}
    assert got["Total Jobs"] == "1" and got["Interested Jobs"] == "1"
    assert got["Last Run Time"] == "2026-06-08T13:30:00+00:00"
    assert got["Next Expected Run Time"] == "2026-06-08T16:00:00+00:00"
    late = {r.Metric: r.Value for r in P.summary_metrics(_store(spark), "2026-06-08 21:00:00", ["09:00"]).collect()}
    assert late["Next Expected Run Time"] == "2026-06-09T09:00:00+00:00"


def test_feed_manifest_and_envelope(spark):
    feed = P.public_feed(_store(spark), 35)
    m = P.feed_manifest(feed, 35, "2026-06-08 11:00:00").first()
    assert (m.minimum_score, m.total) == (35, 1)
    env = P.feed_envelope(feed, 35, "2026-06-08 11:00:00").first()
    assert env.total == 1 and env.jobs[0].title == "Shader Artist"


def test_buckets_actions_and_migration(spark):
    feed = P.public_feed(_store(spark), 35).withColumn("feed_pos", F.lit(1))
    h = feed.first().job_hash
    legacy = "Shader Artist||North||Oslo||https://h.io/j/5"
    log = spark.createDataFrame([(1, legacy, "applyed"), (2, "other", "not-fit"), (3, "other", "review")],
                                "seq long, job_key string, action string")
    current = X.apply_actions(log)
    assert {r.job_key: r.action for r in current.collect()} == {legacy: "applyed"}
    migrated = X.migrate_actions(current, feed)
    assert {r.job_key: r.action for r in migrated.collect()} == {h: "applied"}
    buckets = X.review_buckets(feed, migrated)
    assert buckets.first().bucket == "applied"
    counts = {r.bucket: r["count"] for r in X.bucket_counts(buckets).collect()}
    assert counts == {"review": 0, "applied": 1, "not-fit": 0, "total": 1}


def test_display_and_safe_links(spark):
    feed = spark.createDataFrame(
        [("h1", "", "", "", "javascript:alert(1)", 75, ""), ("h2", "Austin", "Applied", "r", "https://x.y/", 10, "2026-06-08T09:00:00+00:00")],
        "job_hash string, location string, status string, match_reason string, url string, match_score int, date_found string",
    )
    got = {r.job_hash: r for r in X.display_rows(feed).collect()}
    assert got["h1"].location_text == "Location not listed" and got["h1"].status_text == "New"
    assert got["h1"].link == "#" and got["h1"].high and got["h1"].found_text == "Found Unknown date"
    assert got["h2"].link == "https://x.y/" and got["h2"].found_text == "Found Jun 8, 2026"


def test_search_and_summary(spark):
    feed = spark.createDataFrame(
        [("a", "Graphics Engineer", "Acme", "Remote - United States", "", "", 80, "New"),
         ("b", "Tools", "Beta", "Berlin", "", "", 40, "New"),
         ("c", "Graphics", "", "Seattle, WA", "", "", 10, "Applied")],
        "job_hash string, title string, company string, location string, match_reason string, employment_type string, "
        "match_score int, status string",
    )
    assert [r.job_hash for r in X.search_feed(feed, query=" GRAPHICS ").collect()] == ["a"]
    assert [r.job_hash for r in X.search_feed(feed, location="us", minimum_score=0).collect()] == ["a"]
    s = X.feed_summary(feed).first()
    assert (s.jobs, s.strong, s.companies, s.remote, s.top_score) == (3, 1, 2, 1, 80)


def test_cluster_conf_scales_with_input():
    from postline.session import cluster_conf

    big = cluster_conf(100 * (1 << 40), total_cores=4000)
    small = cluster_conf(50 << 20, total_cores=8)
    assert int(big["spark.sql.shuffle.partitions"]) >= 500_000
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 << 20
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert 32 << 20 <= int(small["spark.sql.files.maxPartitionBytes"]) <= 256 << 20


def test_review_export_writes_five_relations(spark, tmp_dir):
    import os

    from postline.operators.scoring import default_rules

    store = _store(spark)
    sources = spark.createDataFrame([(0, "board", "lever", True, "acme-board", None, "n")],
                                    "pos int, name string, type string, enabled boolean, company_slug string, url string, notes string")
    checks = spark.createDataFrame([("board", "2026-06-08 09:00:00", "Success: 1 jobs")],
                                   "source_name string, last_checked string, last_result string").withColumn(
        "last_checked", F.col("last_checked").cast("timestamp"))
    runs = spark.createDataFrame([("2026-06-08 09:00:00", 1, 1, 1, "", 1.0)],
                                 "run_time string, sources_checked int, jobs_found long, new_jobs_added long, errors string, duration_seconds double"
                                 ).withColumn("run_time", F.col("run_time").cast("timestamp"))
    paths = P.write_review_export(os.path.join(tmp_dir, "review"), store, sources, checks, default_rules(), runs,
                                  "2026-06-08 13:00:00", ["09:00", "16:00"])
    read = {k: spark.read.option("header", True).csv(v) for k, v in paths.items()}
    assert read["Jobs"].count() == 1 and read["Jobs"].first()["Status"] == "Interested"
    assert read["Sources"].first()["URL"] == "acme-board"
    assert read["Keywords"].count() == 62
    summary = {r.Metric: r.Value for r in read["Summary"].collect()}
    assert summary["Total Jobs"] == "1" and summary["Next Expected Run Time"] == "2026-06-08T16:00:00+00:00"
    assert read["Run_Log"].first()["Run Time"] == "2026-06-08T09:00:00+00:00"
