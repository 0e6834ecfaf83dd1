import json
import os

from pyspark.sql import functions as F

from postline.operators.scoring import Rule
from postline.streaming.ingest import running_first_last_seen, stream_ingest

RULES = [Rule("include", 0, "Vulkan", 15.0)]


def _write(root, source, name, items):
    d = os.path.join(root, f"source_name={source}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as fh:
        fh.write(json.dumps(items) + "\n")


def test_stream_ingest_merges_micro_batches(spark, tmp_dir):
    landed = os.path.join(tmp_dir, "lever")
    _write(landed, "acme", "a.json", [{"text": "Engine Dev", "hostedUrl": "https://a/1", "categories": {"location": "Austin"},
                                       "createdAt": 1700000000000}])
    _write(landed, "acme", "b.json", [{"text": "Engine Dev v2", "hostedUrl": "https://a/1", "categories": {"location": "Austin"},
                                       "descriptionPlain": "Vulkan", "createdAt": 1700000001000},
                                      {"text": "Other", "hostedUrl": "https://a/2", "categories": {"location": "Paris"},
                                       "createdAt": 1700000002000}])
    table = os.path.join(tmp_dir, "table")
    ckpt = os.path.join(tmp_dir, "ckpt")
    out = stream_ingest(spark, landed, table, ckpt, RULES, files_per_batch=1).collect()
    assert len(out) == 1  # Paris is not eligible; the two sightings of /1 merge
    r = out[0]
    assert (r.title, r.match_score) == ("Engine Dev v2", 15)
    assert r.date_found < r.last_seen  # second micro-batch updated the row
    # a restart finds no new files and leaves the table as it is
    again = stream_ingest(spark, landed, table, ckpt, RULES, files_per_batch=1).collect()
    assert [tuple(x) for x in again] == [tuple(x) for x in out]


def test_postings_without_a_date_and_with_faults(spark, tmp_dir):
    landed = os.path.join(tmp_dir, "lever")
    _write(landed, "acme", "a.json", [
        {"text": "No date", "hostedUrl": "https://a/1", "categories": {"location": "Austin"}},
        {"text": "Dated", "hostedUrl": "https://a/2", "categories": {"location": "Austin"}, "createdAt": 5},
        {"text": "Bad", "hostedUrl": "https://a/3", "categories": ["Austin"]},
    ])
    sources = spark.createDataFrame([("acme", "Acme Corp")], "name string, company string")
    for i, every in enumerate((None, 4)):
        table = os.path.join(tmp_dir, f"t{i}")
        out = stream_ingest(spark, landed, table, os.path.join(tmp_dir, f"c{i}"), RULES, merge_every=every, sources=sources).collect()
        assert sorted((r.title, r.company) for r in out) == [("Dated", "Acme Corp"), ("No date", "Acme Corp")]
        assert [r.error for r in spark.read.parquet(f"{table}/_quarantine").collect()] == ["acme: CollectorError: Unexpected lever posting: categories"]


def test_running_first_last_seen_equals_batch(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    got = running_first_last_seen(spark, sf, os.path.join(tmp_dir, "seen"))
    ev = spark.read.parquet(f"{sf}/events.parquet")
    want = ev.groupBy(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("entity")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("first_seen"), F.max(F.col("ts").cast("timestamp")).alias("last_seen"),
        F.count(F.lit(1)).alias("sightings"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_staged_merge_equals_per_batch_merge(spark, tmp_dir):
    landed = os.path.join(tmp_dir, "lever")
    for i in range(5):
        _write(landed, "acme", f"{i}.json", [
            {"text": f"Engine Dev {i}", "hostedUrl": "https://a/1", "categories": {"location": "Austin" if i != 3 else "Paris"},
             "descriptionPlain": "Vulkan" if i % 2 else "", "createdAt": 1700000000000 + i},
            {"text": f"Role {i}", "hostedUrl": f"https://a/{10 + i}", "categories": {"location": "Seattle, WA"},
             "createdAt": 1700000000100 + i},
        ])
    cols = ["job_hash", "entity_key", "title", "match_score", "date_found", "last_seen", "created_at", "updated_at"]
    a = stream_ingest(spark, landed, os.path.join(tmp_dir, "t1"), os.path.join(tmp_dir, "c1"), RULES, files_per_batch=1)
    b = stream_ingest(spark, landed, os.path.join(tmp_dir, "t2"), os.path.join(tmp_dir, "c2"), RULES, files_per_batch=1,
                      merge_every=2)
    rows_a = sorted(tuple(r) for r in a.select(*cols).collect())
    rows_b = sorted(tuple(r) for r in b.select(*cols).collect())
    assert rows_a == rows_b and len(rows_a) == 6


def test_the_stream_quarantines_like_the_batch_and_keeps_raw_postings(spark, tmp_dir):
    from postline.sources import payloads

    landed = os.path.join(tmp_dir, "lever")
    good = {"text": "Good", "hostedUrl": "https://a/1", "categories": {"location": "Austin"}, "createdAt": 7, "team": "Core"}
    _write(landed, "acme", "a.json", [good, {"text": ["bad"]}])
    _write(landed, "acme", "b.json", {"error": "rate limited"})
    with open(os.path.join(landed, "source_name=acme", "c.json"), "w") as fh:
        fh.write("not json\n\n")
    want = sorted(r.error for r in payloads.quarantine(spark, landed, "lever").collect())
    assert len(want) == 3
    for i, every in enumerate((None, 1, 2, 5)):
        table = os.path.join(tmp_dir, f"t{i}")
        out = stream_ingest(spark, landed, table, os.path.join(tmp_dir, f"c{i}"), RULES, files_per_batch=1, merge_every=every).collect()
        assert [(r.title, json.loads(r.raw_data)) for r in out] == [("Good", good)]
        assert sorted(r.error for r in spark.read.parquet(f"{table}/_quarantine").collect()) == want


def test_state_is_carried_across_batches(spark, tmp_dir):
    events = os.path.join(tmp_dir, "events")
    rows = [("view", i % 3, f"2026-01-{1 + i:02d} 00:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "event_type string, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):
        df.filter(F.dayofmonth("ts").between(3 * i + 1, 3 * i + 3)).coalesce(1).write.mode("append").parquet(events)
    base = os.path.join(tmp_dir, "seen")
    got = running_first_last_seen(spark, events, base, file_glob="*.parquet")
    assert sorted((r.entity, r.first_seen.day, r.last_seen.day, r.sightings) for r in got.collect()) == [("view:0", 1, 10, 4), ("view:1", 2, 11, 4), ("view:2", 3, 12, 4)]
    updates = spark.read.parquet(os.path.join(base, "updates"))
    assert updates.select("batch_id").distinct().count() == 4 and updates.filter("sightings > 1").count() == 9
