import glob
import json
import os

from pyspark.sql import DataFrame

from postline.operators import snapshots as K
from postline.sources import payloads
from postline.operators.scoring import Rule
from postline.plans import workflow

RULES = [Rule("include", 0, "Vulkan", 15.0), Rule("title_boost", 0, "Graphics Engineer", 30.0)]


def _write(root, kind, source, payload):
    d = os.path.join(root, kind, f"source_name={source}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "p.json"), "w") as fh:
        fh.write(json.dumps(payload) + "\n")


def test_two_runs_keep_edits_and_purge(spark, tmp_dir):
    landed = os.path.join(tmp_dir, "landed")
    _write(landed, "lever", "acme", [
        {"text": "Graphics Engineer", "hostedUrl": "https://acme.example/1", "categories": {"location": "Austin"},
         "descriptionPlain": "Vulkan work"},
        {"text": "Graphics Engineer Intern", "hostedUrl": "https://acme.example/2", "categories": {"location": "Austin"}},
        {"text": "Tools Engineer", "categories": {"location": "Berlin"}},
    ])
    _write(landed, "ashby", "beta", {"jobs": "unavailable"})
    _write(landed, "html", "site", {"url": "https://site.example/", "html": '<a href="a">Tools</a><a href="b">Art</a>'})
    sources = spark.createDataFrame(
        [(0, "acme", "lever", True, None), (1, "beta", "ashby", True, "Beta Inc"), (2, "gamma", "workday", True, None),
         (3, "off", "lever", False, None), (4, "site", "HTML", True, None)],
        "pos int, name string, type string, enabled boolean, company string",
    )
    paths = {kind: os.path.join(landed, kind) for kind in ("lever", "ashby", "html")}
    store_root = os.path.join(tmp_dir, "store")
    r1 = workflow.run(spark, store_root, sources, paths, RULES, "2026-06-08 09:00:00")
    rows = {r.url: r for r in r1.store.collect()}
    assert set(rows) == {"https://acme.example/1"}  # intern and non-US rows are skipped
    assert rows["https://acme.example/1"].match_score == 45 and rows["https://acme.example/1"].company == "acme"
    stats = r1.run_log.first()
    assert (stats.sources_checked, stats.jobs_found, stats.new_jobs_added, stats.run_status) == (4, 5, 1, 1)
    assert stats.errors.splitlines() == [
        "beta: CollectorError: Unexpected ashby API response",
        "gamma: ValueError: Unsupported source type: workday",
    ]
    checks = {r.source_name: r.last_result for r in r1.checks.collect()}
    assert checks["acme"] == "Success: 3 jobs" and checks["site"] == "Success: 2 jobs" and checks["gamma"].startswith("gamma: ValueError")
    assert r1.feed.count() == 1 and r1.jobs_sheet.count() == 1

    h = rows["https://acme.example/1"].job_hash
    edits = spark.createDataFrame([(1, h, "", "Applied", "sent")], "seq long, job_hash string, url string, status string, notes string")
    out = os.path.join(tmp_dir, "out")
    r2 = workflow.run(spark, store_root, sources, paths, RULES, "2026-06-08 12:00:00", edits=edits, old_checks=r1.checks,
                      export_dir=out, slots=["09:00"])
    review = spark.read.option("header", True).option("multiLine", True).csv(os.path.join(out, "review", "Run_Log"))
    assert review.count() == 2  # both runs are in the run log
    assert payloads.read_feed(spark, os.path.join(out, "feed")).count() == 1
    assert not os.path.exists(os.path.join(store_root, "_staging", "2026-06-08T120000"))
    row = r2.store.first()
    assert (row.status, row.notes, str(row.date_found), str(row.last_seen)) == (
        "Applied", "sent", "2026-06-08 09:00:00", "2026-06-08 12:00:00")
    assert r2.run_log.first().new_jobs_added == 0
    assert K.current_version(store_root) == 2


def test_snapshot_pointer_and_unchanged_skip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, v string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "id int, v string")
    assert K.write_snapshot(a, root) == 1
    assert K.write_snapshot(b, root) == 1  # same rows in another order: no new version
    assert K.write_snapshot(c, root) == 2
    assert sorted(r.v for r in K.read_current(spark, root).collect()) == ["x", "z"]
    manifest = spark.createDataFrame([(v,) for v in range(1, 26)], "version int")
    assert sorted(r.version for r in K.expired_snapshots(manifest, 20).collect()) == [1, 2, 3, 4, 5]


def test_pointer_files_through_hadoop_fs(spark, tmp_dir):
    root = "file://" + os.path.join(tmp_dir, "ptr")
    assert K.read_pointer(root + "/CURRENT", spark) is None
    K.write_pointer(root + "/CURRENT", "1", spark)
    K.write_pointer(root + "/CURRENT", "2", spark)  # replaces the old file
    assert K.read_pointer(root + "/CURRENT", spark) == "2"
    assert K.current_version(root, spark) == 2
    # a version folder left by a crashed write is overwritten by the retry
    df = spark.createDataFrame([(1,)], "x int")
    df.write.parquet(root + "/v=3")
    assert K.write_snapshot(df.union(df), root, only_if_changed=False) == 3
    assert K.read_current(spark, root).count() == 2


def test_old_versions_are_deleted_and_the_live_one_stays(spark, tmp_dir):
    root = os.path.join(tmp_dir, "versions")
    for i in range(5):
        K.write_snapshot(spark.createDataFrame([(i,)], "id int"), root)
    assert K.expire_versions(root, 2, spark) == [1, 2, 3]
    assert [n for n in K.children(root, spark) if n.startswith("v=")] == ["v=4", "v=5"] and K.read_current(spark, root).first().id == 4
    assert K.expire_versions(root, 2, spark) == [] and K.expire_versions(os.path.join(tmp_dir, "none"), 1, spark) == []
    K.write_pointer(root + "/CURRENT", "4", spark)
    assert K.expire_versions(root, 1, spark) == [] and K.read_current(spark, root).first().id == 3


def test_an_unchanged_feed_is_not_published_again(spark, tmp_dir):
    root = os.path.join(tmp_dir, "feed")
    manifest = spark.createDataFrame([("t1", 20, 2)], "generated_at string, minimum_score int, total long")
    feed = spark.createDataFrame([("h1", "A", 50), ("h2", "B", 40)], "job_hash string, title string, match_score int")
    first = K.publish_feed(feed, manifest, root)
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{root}/{first}/*/*")}
    assert K.publish_feed(feed.orderBy("title"), manifest.replace("t1", "t2"), root) == first
    assert {p: os.path.getmtime(p) for p in glob.glob(f"{root}/{first}/*/*")} == before
    assert {r.generated_at for r in payloads.read_feed(spark, root).collect()} == {"t1"}
    second = K.publish_feed(feed.filter("match_score > 45"), manifest, root)
    assert second != first and [r.title for r in payloads.read_feed(spark, root).collect()] == ["A"]
    assert glob.glob(f"{root}/{first}/jobs/*.json")  # readers that have opened it go on
    third = K.publish_feed(feed.filter("match_score < 45"), manifest, root)
    assert sorted(n for n in os.listdir(root) if "-" in n) == sorted([second, third])


def test_payloads_are_tested_once_and_the_batch_is_staged_once(spark, tmp_dir, monkeypatch):
    landed = os.path.join(tmp_dir, "landed")
    _write(landed, "lever", "acme", [{"text": "Graphics Engineer", "hostedUrl": "https://acme.example/1", "categories": {"location": "Austin"}}])
    _write(landed, "ashby", "beta", {"jobs": "unavailable"})
    sources = spark.createDataFrame(
        [(0, "acme", "lever", True, None), (1, "beta", "ashby", True, None)], "pos int, name string, type string, enabled boolean, company string"
    )
    read, staged = [], []

    def told(f):
        def call(*args):
            read.extend(path for df in args if isinstance(df, DataFrame) for path in df.inputFiles())
            return f(*args)

        return call

    for name in ("source_results", "run_record"):
        monkeypatch.setattr(workflow.U, name, told(getattr(workflow.U, name)))
    monkeypatch.setattr(workflow, "_stage", lambda df, path, f=workflow._stage: (staged.append(os.path.basename(path)), f(df, path))[1])
    r = workflow.run(spark, os.path.join(tmp_dir, "store"), sources, {k: os.path.join(landed, k) for k in ("lever", "ashby")}, RULES, "2026-06-08 09:00:00")
    assert read and not [x for x in read if "/landed/" in x]  # errors come from what was written, not from the payloads again
    assert "errors" in staged and "flagged" in staged and "raw" not in staged
    assert (r.run_log.first().jobs_found, r.run_log.first().errors) == (1, "beta: CollectorError: Unexpected ashby API response")
    assert {c.source_name: c.last_result for c in r.checks.collect()}["acme"] == "Success: 1 jobs"
