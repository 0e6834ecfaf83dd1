import random

from pyspark.sql import functions as F

from postline.constants import EXPORT_CONTROL_PHRASE
from postline.functions.identity import job_hash
from postline.operators import exports as P
from postline.operators import merge
from tests.conftest import frame

AS1 = "2025-02-03 06:30:00"
AS2 = "2025-02-10 06:30:00"
EDITS = "seq long, job_hash string, url string, status string, notes string"


def scored(spark, rows, score=55):
    """Normalised rows with a score; rows are (url, title, description)."""
    df = frame(spark, [dict(seq=i, title=t, company="Lumen Forge", location="Tulsa, OK", url=u, source_name="forge", source_type="lever", description=d) for i, (u, t, d) in enumerate(rows, 1)])
    return merge.normalize_postings(df).withColumn("match_score", F.lit(score)).withColumn("match_reason", F.lit("why"))


def _job(spark, score=80, description="", url="https://forge.example/o/77"):
    return scored(spark, [(url, "Shader Tools Lead", description)], score)


THREE = [("https://forge.example/o/1", "Pipeline TD", "usd and c++"), ("https://forge.example/o/2", "Build Engineer", None), ("", "Rigging TD", "100% remote")]


def stored(spark, rows=THREE):
    return merge.upsert(merge.empty_store(spark), scored(spark, rows), AS1).drop("is_new")


def test_an_edit_by_url_survives_the_next_sighting(spark):
    store = stored(spark)
    edits = spark.createDataFrame([(4, None, " https://FORGE.example/o/2#apply ", "Interested", "call back")], EDITS)
    assert [(r.url, r.status) for r in merge.edits_that_hit(store, edits).collect()] == [("https://forge.example/o/2", "Interested")]
    edited = merge.apply_edits(store, edits, "2025-02-04 00:00:00")
    assert {(r.title, r.status, r.notes, r.edited) for r in edited.collect()} == {("Pipeline TD", "New", "", False), ("Build Engineer", "Interested", "call back", True), ("Rigging TD", "New", "", False)}
    again = merge.upsert(edited.drop("edited"), scored(spark, [THREE[1][:2] + ("rewritten",)]), AS2)
    row = {r.title: r for r in again.collect()}["Build Engineer"]
    assert (row.status, row.notes, row.description, row.is_new) == ("Interested", "call back", "rewritten", False)
    assert str(row.date_found) == AS1 and str(row.last_seen) == str(row.updated_at) == AS2


def test_of_two_edits_of_a_row_the_later_wins_whatever_its_key(spark):
    store = stored(spark)
    key = {r.title: r.job_hash for r in store.collect()}
    for first, second, want in (("hash", "url", "Rejected"), ("url", "hash", "Rejected"), ("hash", "hash", "Rejected"), ("url", "url", "Rejected")):
        def edit(seq, by, status):
            return (seq, key["Pipeline TD"] if by == "hash" else "", "https://forge.example/o/1" if by == "url" else "", status, by)  # noqa: B023

        rows = [edit(2, second, want), edit(1, first, "Applied"), (3, key["Pipeline TD"], "", "no such status", "x")]
        out = {r.title: (r.status, r.notes) for r in merge.apply_edits(store, spark.createDataFrame(rows, EDITS), AS2).collect()}
        assert out["Pipeline TD"] == (want, second) and out["Build Engineer"] == ("New", ""), (first, second)


def test_an_edit_on_an_unknown_key_changes_nothing(spark):
    store = stored(spark)
    edits = spark.createDataFrame([(1, "0" * 64, "https://forge.example/o/1", "Applied", "x"), (2, "", "https://forge.example/unknown", "Applied", "y"), (3, None, None, "Applied", "z")], EDITS)
    assert merge.edits_that_hit(store, edits).count() == 0
    out = merge.apply_edits(store, edits, AS2)
    assert out.filter("edited").count() == 0 and sorted(map(tuple, out.drop("edited").collect()), key=repr) == sorted(map(tuple, store.collect()), key=repr)


def test_a_phrase_may_hold_wildcards_and_null_text_never_matches(spark):
    store = stored(spark)
    titles = lambda text: sorted(r.title for r in merge.phrase_purge(store, text).collect())
    assert titles("USD%C++") == ["Build Engineer", "Rigging TD"]
    assert titles("_igging") == ["Build Engineer", "Pipeline TD"]
    assert titles("rewritten") == sorted(t for _, t, _ in THREE) and titles("why") == []
    null = store.withColumn("description", F.lit(None).cast("string")).withColumn("match_reason", F.lit(None).cast("string"))
    assert merge.phrase_purge(null, "remote").count() == 3
    assert merge.phrase_purge(stored(spark, [("", "Any", "x " + EXPORT_CONTROL_PHRASE.upper())]), EXPORT_CONTROL_PHRASE).count() == 0


def test_rows_below_the_threshold_stay_in_the_store(spark):
    store = merge.upsert(merge.empty_store(spark), scored(spark, THREE, score=3), AS1).drop("is_new")
    assert (store.count(), P.jobs_sheet(store, 4).count(), P.jobs_sheet(store, 3).count()) == (3, 0, 3)


def test_blank_and_unknown_hashes_purge_nothing(spark):
    store = stored(spark)
    one = store.filter("title = 'Build Engineer'").first().job_hash
    doomed = spark.createDataFrame([(one,), (one,), ("",), (None,), ("f" * 64,)], "job_hash string")
    assert sorted(r.title for r in merge.hash_purge(store, doomed).collect()) == ["Pipeline TD", "Rigging TD"]


def test_the_collapse_has_no_aggregate_over_wide_fields_and_one_wide_shuffle(spark):
    batch = scored(spark, THREE * 2)
    plan = merge.collapse_batch(batch)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Aggregate" in line and "description" in line]
    assert wide == [] and "WindowGroupLimit" in plan and plan.count("Partial") >= 1
    assert len([x for x in plan.splitlines() if "Window " in x]) == 1


def test_rows_without_order_and_ties(spark):
    rows = scored(spark, [("https://forge.example/o/9", t, t) for t in ("a", "b", "c")])
    late = rows.withColumn("seq", F.when(F.col("title") == "b", F.lit(None)).otherwise(F.lit(5)).cast("long"))
    one = merge.collapse_batch(late).collect()
    assert len(one) == 1 and one[0].sightings == 3 and one[0].title in ("a", "c")
    assert merge.collapse_batch(late.orderBy(F.col("title").desc()).repartition(3)).first().title == one[0].title
    only = merge.collapse_batch(rows.withColumn("seq", F.lit(None).cast("long"))).collect()
    assert len(only) == 1 and (only[0].first_seq, only[0].sightings) == (None, 3)


def test_a_second_purge_with_equal_rules_evaluates_no_pattern(spark):
    from postline.operators import eligibility as E

    rows = scored(spark, [(f"https://forge.example/o/{i}", "Build Engineer Intern" if i % 3 == 0 else "Build Engineer", "x") for i in range(12)])
    store = merge.upsert(merge.empty_store(spark), E.with_verdict(rows, E.is_eligible(rows)), AS1).drop("is_new")
    assert store.filter(E.fresh_verdict(store)).count() == 12
    kept = merge.eligibility_purge(store)
    assert kept.count() == 8 == merge.eligibility_purge(store.drop("verdict")).count()
    # the verdict alone decides while it is fresh: a wrong one shows that no pattern is asked
    lie = store.withColumn("verdict", F.col("verdict").withField("eligible", ~F.col("verdict.eligible")))
    assert merge.eligibility_purge(lie).count() == 4
    # other text, or other rules: evaluated anew
    for stale in (lie.withColumn("location", F.lit("Reno, NV")), lie.withColumn("verdict", F.col("verdict").withField("rules", F.lit("older")))):
        assert stale.filter(E.fresh_verdict(stale)).count() == 0 and merge.eligibility_purge(stale).count() == 8
    # the verdict goes with the text: an update brings its own, an untouched row keeps its own
    new = E.with_verdict(scored(spark, [("https://forge.example/o/1", "Build Engineer", "y")]), F.lit(True))
    after = merge.upsert(store, new, AS2).drop("is_new")
    assert after.filter(E.fresh_verdict(after)).count() == 12
    assert merge.upsert(store, new.drop("verdict"), AS2).filter("verdict is null").count() == 1


def test_invalid_status_rejects_whole_edit(spark):
    store = merge.upsert(merge.empty_store(spark), _job(spark), AS1).drop("is_new")
    h = store.first().job_hash
    edits = spark.createDataFrame([(1, h, "", "Maybe", "note")], "seq long, job_hash string, url string, status string, notes string")
    out = merge.apply_edits(store, edits, AS2).first()
    assert (out.status, out.notes, out.edited) == ("New", "", False)


def test_edit_by_url_only_when_no_hash(spark):
    store = merge.upsert(merge.empty_store(spark), _job(spark), AS1).drop("is_new")
    edits = spark.createDataFrame(
        [(1, "", "HTTPS://forge.example/o/77/?utm_source=x", "Interested", None),
         (2, "deadbeef", "https://forge.example/o/77", "Rejected", "wrong hash")],
        "seq long, job_hash string, url string, status string, notes string",
    )
    out = merge.apply_edits(store, edits, AS2).first()
    assert (out.status, out.notes) == ("Interested", "")


# --- replay property: set-based collapse + merge equals row-by-row upserts -----------
def _replay(batches):
    """Row-at-a-time reference: look up by hash, then by URL; first insert wins the hash."""
    rows = []
    for t, batch in enumerate(batches):
        for r in batch:
            hit = next((x for x in rows if x["job_hash"] == r["job_hash"]), None)
            if hit is None and r["url"]:
                hit = next((x for x in rows if x["url"] == r["url"]), None)
            if hit:
                hit.update(title=r["title"], location=r["location"], match_score=r["match_score"], last_seen=t)
            else:
                rows.append(dict(job_hash=r["job_hash"], url=r["url"], title=r["title"], location=r["location"],
                                 match_score=r["match_score"], date_found=t, last_seen=t))
    return sorted((x["job_hash"], x["url"], x["title"], x["location"], x["match_score"], x["date_found"], x["last_seen"])
                  for x in rows)


def test_collapse_then_merge_equals_replay(spark):
    import hashlib

    rnd = random.Random(11)
    titles = ["Graphics Engineer", "Tools Programmer", "Engine Programmer"]
    locs = ["Austin", "Seattle, WA", "New York, NY"]
    urls = ["", "", "https://ex.com/1", "https://ex.com/2"]
    for trial in range(5):
        batches = []
        seq = 0
        for b in range(3):
            batch = []
            for _ in range(rnd.randint(3, 8)):
                seq += 1
                t, loc, u = rnd.choice(titles), rnd.choice(locs), rnd.choice(urls)
                third = u if u else loc.lower()
                h = hashlib.sha256(f"{t.lower()}|acme|{third}".encode()).hexdigest()
                batch.append(dict(seq=seq, title=t, location=loc, url=u, job_hash=h, match_score=rnd.randint(0, 100)))
            batches.append(batch)
        want = _replay(batches)

        store = merge.empty_store(spark)
        for t, batch in enumerate(batches):
            df = frame(spark, [dict(seq=r["seq"], title=r["title"], company="Acme", location=r["location"], url=r["url"])
                               for r in batch])
            n = merge.normalize_postings(df)
            scores = spark.createDataFrame([(r["seq"], r["match_score"]) for r in batch], "seq long, match_score int")
            n = n.join(scores, "seq").withColumn("match_reason", F.lit("r"))
            store = merge.upsert(store, n, f"2026-01-0{t + 1} 00:00:00").drop("is_new")
            store = spark.createDataFrame(store.collect(), store.schema)  # cut the plan between runs
        got = sorted(
            (r.job_hash, r.url, r.title, r.location, r.match_score, r.date_found.day - 1, r.last_seen.day - 1)
            for r in store.collect()
        )
        assert got == want, trial


def test_upsert_is_idempotent_for_a_repeated_batch(spark):
    store = merge.upsert(merge.empty_store(spark), _job(spark), AS1).drop("is_new")
    once = merge.upsert(store, _job(spark), AS2).drop("is_new")
    twice = merge.upsert(once, _job(spark), AS2).drop("is_new")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_latest_checks(spark):
    old = spark.createDataFrame([("a", "2026-01-01 00:00:00", "Success: 1 jobs", 0), ("b", "2026-01-01 00:00:00", "x", 0)],
                                "source_name string, last_checked string, last_result string, seq long")
    new = spark.createDataFrame([("a", "2026-01-02 00:00:00", "a: ValueError: boom", 1)],
                                "source_name string, last_checked string, last_result string, seq long")
    old = old.withColumn("last_checked", F.col("last_checked").cast("timestamp"))
    new = new.withColumn("last_checked", F.col("last_checked").cast("timestamp"))
    got = {r.source_name: r.last_result for r in merge.latest_checks(old, new).collect()}
    assert got == {"a": "a: ValueError: boom", "b": "x"}


def test_expire_ineligible_option(spark):
    from postline.operators.merge import flag_batch

    first = frame(spark, [dict(seq=1, title="Graphics Engineer", company="Acme", location="Austin", url="https://a/1")])
    store = merge.upsert(merge.empty_store(spark), flag_batch(first), AS1, eligible="eligible").drop("is_new")
    moved = frame(spark, [dict(seq=2, title="Graphics Engineer", company="Acme", location="Berlin", url="https://a/1"),
                          dict(seq=3, title="Tools", company="Acme", location="Paris", url="https://a/9")])
    kept = merge.upsert(store, flag_batch(moved), AS2, eligible="eligible").drop("is_new").collect()
    assert [(r.url, r.location) for r in kept] == [("https://a/1", "Austin")]  # sighting skipped, row kept
    gone = merge.upsert(store, flag_batch(moved), AS2, eligible="eligible", expire_ineligible=True).collect()
    assert gone == []
    back = frame(spark, [dict(seq=4, title="Graphics Engineer", company="Acme", location="Berlin", url="https://a/1"),
                         dict(seq=5, title="Graphics Engineer", company="Acme", location="Seattle, WA", url="https://a/1")])
    rows = merge.upsert(store, flag_batch(back), AS2, eligible="eligible", expire_ineligible=True).collect()
    assert [(r.location, r.is_new) for r in rows] == [("Seattle, WA", False)]  # newest sighting eligible


def test_sheet_round_trip_keeps_human_edits(spark, tmp_dir):
    """Export the review sheet, edit it like a person would, import, run again."""
    import glob
    import os

    import pandas as pd

    from postline.sources.payloads import read_edits_csv

    store = merge.upsert(merge.empty_store(spark), _job(spark), AS1).drop("is_new")
    path = os.path.join(tmp_dir, "sheet")
    P.write_jobs_sheet_csv(store, path, 35)
    part = [f for f in glob.glob(os.path.join(path, "part-*.csv")) if os.path.getsize(f) > 0][0]
    sheet = pd.read_csv(part, dtype=str, keep_default_na=False)
    assert list(sheet.columns)[:4] == ["Date Found", "Last Seen", "Status", "Score"]
    sheet.loc[0, "Status"] = "Applied"
    sheet.loc[0, "Notes"] = "Applied on company site"
    edited = os.path.join(tmp_dir, "edited")  # the person saves a new file
    os.makedirs(edited)
    sheet.to_csv(os.path.join(edited, "jobs.csv"), index=False)
    edits = read_edits_csv(spark, edited)
    assert merge.edits_that_hit(store, edits).count() == 1
    store = merge.apply_edits(store, edits, "2026-06-08 10:00:00").drop("edited")
    again = merge.upsert(store, _job(spark, description="Updated description"), AS2).drop("is_new")
    row = P.jobs_sheet(again, 35).first()
    assert (row["Status"], row["Notes"]) == ("Applied", "Applied on company site")
