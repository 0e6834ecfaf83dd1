"""What is shuffled as the tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from postline.operators import merge
from postline.operators.ordering import broadcast_if_light
from postline.sources import fixtures as fx


@pytest.fixture()
def no_size_guess(spark):
    """Joins are broadcast by hint only."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def flagged(spark):
    text = [c for c in merge.SOURCE_FIELDS]
    rows = [(i, f"k{i % 4}", f"h{i}", i % 3 == 0, 50, "r", *[f"{c}{i}" for c in text]) for i in range(12)] + [(20, "none", "h20", False, None, None, *text), (21, "null", "h21", None, None, None, *text)]
    names = ["seq", "entity_key", "job_hash", "eligible", "match_score", "match_reason", *text]
    kinds = "seq long, entity_key string, job_hash string, eligible boolean, match_score int, match_reason string, " + ", ".join(f"{c} string" for c in text)
    return spark.createDataFrame(rows, kinds).select(*names)


def test_collapse_shuffles_no_ineligible_text(spark):
    batch = flagged(spark)
    out = merge.collapse_batch(batch, eligible="eligible")
    assert re.search(r"Filter [^\n]*eligible", out._jdf.queryExecution().optimizedPlan().toString())
    got = {r.entity_key: (r.job_hash, r.sightings, r.title) for r in out.collect()}
    assert got == {"k0": ("h0", 1, "title0"), "k1": ("h9", 1, "title9"), "k2": ("h6", 1, "title6"), "k3": ("h3", 1, "title3")}
    kept = merge.collapse_batch(batch, eligible="eligible", keep_ineligible=True)
    assert {r.entity_key: r.sightings for r in kept.collect()} == {"k0": 1, "k1": 1, "k2": 1, "k3": 1, "none": 0, "null": 0}


def test_edits_leave_the_stored_rows_where_they_are(spark, tmp_path, no_size_guess):
    merge.upsert(merge.empty_store(spark), flagged(spark), "2026-01-01", eligible="eligible").drop("is_new").write.parquet(f"file://{tmp_path}/stored")
    stored = spark.read.parquet(f"file://{tmp_path}/stored")
    edits = spark.createDataFrame([(1, "h0", "", "Applied", "n")], "seq long, job_hash string, url string, status string, notes string")
    out = merge.apply_edits(stored, edits, "2026-01-02")
    assert "SortMergeJoin" not in planned(out)
    assert {r.job_hash: (r.status, r.notes, r.edited) for r in out.collect()} == {"h0": ("Applied", "n", True), "h3": ("New", "", False), "h6": ("New", "", False), "h9": ("New", "", False)}


def test_broadcast_only_what_is_light(spark, no_size_guess):
    wide, rows = spark.range(50), spark.createDataFrame([(i, "x" * 100) for i in range(50)], "id long, s string")
    for most, light in ((50 * 132, True), (50 * 132 - 1, False)):
        joined = wide.join(broadcast_if_light(rows, most), "id")
        assert ("BroadcastHashJoin" in planned(joined)) == light and joined.count() == 50
    assert wide.join(broadcast_if_light(rows.limit(0)), "id", "left").count() == 50


def tables(spark, root, n=40):
    docs = [(i, f"Title {i}\nfirst  body\t{i}", "en", f"source_{i % 8}", 9) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    pages = [(i, f"https://e.com/{i}", "<p>") for i in (*range(0, n, 2), 4, 4)]  # repeated keys stay repeated
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")


def test_postings_join_texts_where_they_are_read(spark, tmp_path, no_size_guess):
    tables(spark, f"file://{tmp_path}")
    out = fx.postings(spark, f"file://{tmp_path}")
    assert "SortMergeJoin" not in planned(out)
    rows = out.collect()
    assert len(rows) == 42 and sum(r.seq == 4 for r in rows) == 3 and sum(r.url == "" for r in rows) == 20


def test_a_scan_with_most_rows_in_one_split_is_dealt_anew(spark, tmp_path):
    target = spark.sparkContext.defaultParallelism
    rows = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 10).alias("t"))
    uneven = rows.repartition(1).unionByName(rows.limit(0).repartition(target + 1))  # many partitions, one with rows
    even = rows.repartition(target + 1)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    if target > fx.UNEVEN:
        assert most(uneven) == 1000 and most(fx.balanced(uneven, "id")) < 1000
    assert fx.balanced(even, "id") is even
