"""Registered queries: one function per operator, each (spark, sf_dir) -> DataFrame.

The shared chain mirrors one run of the workflow on the driver tables:

    postings -> normalise -> eligible -> score -> collapse -> upsert (run 1)
             -> apply edits -> upsert of a second sighting (run 2)
"""

from __future__ import annotations

import hashlib
import os
import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CLEARANCE_EXCLUSION_PHRASE, EXPORT_CONTROL_PHRASE, SNAPSHOTS_KEPT
from ..functions import text as T
from ..functions.dates import iso_text, next_slot, normalize_date
from ..functions.markup import html_to_text
from ..functions.urls import normalize_url, safe_link, url_domain
from ..operators import buckets as B
from ..operators import eligibility as E
from ..operators import explore as X
from ..operators import exports as P
from ..operators import merge
from ..operators import requests_log as R
from ..operators import runs as U
from ..operators import snapshots as K
from ..operators.ordering import REVIEW_READS, review_order, with_global_rank
from ..operators.scoring import score_postings
from ..sources import fixtures as fx
from ..session import work_dir
from ..sources import payloads as S

RULES = list(fx.FIXTURE_RULES)
KINDS = ("lever", "ashby", "greenhouse", "html")


_WRITTEN: dict[tuple[str, str, str], str] = {}
# builders nest (a table's build reads other tables), hence a re-entrant lock
_BUILD_LOCK = threading.RLock()


def persisted(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table written once per session and source folder, then read back.

    The stored postings table is a table on disk in the workflow as well;
    writing it to the shared checkpoint folder cuts the lineage, survives
    executor loss and lets every later query read it instead of re-running
    the ingest.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    with _BUILD_LOCK:
        path = _WRITTEN.get(key)
        if path is None:
            tag = hashlib.sha1(f"{key[0]}|{sf}".encode()).hexdigest()[:12]
            path = os.path.join(work_dir(spark, "tables"), f"{name}-{tag}")
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            _WRITTEN[key] = path
    return spark.read.parquet(path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder for one call of a query that
    writes (appends, versions): calling the query again starts from scratch."""
    import uuid

    return os.path.join(work_dir(spark, name), uuid.uuid4().hex)


def flagged(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """Every posting normalised, flagged for eligibility, scored when eligible."""
    return persisted(spark, sf, f"flagged{shift}", lambda: merge.flag_batch(fx.postings(spark, sf, shift), RULES))


def normalized(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    return flagged(spark, sf, shift).drop("eligible", "match_score", "match_reason")


def scored(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    return flagged(spark, sf, shift).filter(F.col("eligible")).drop("eligible")


def stored_first(spark: SparkSession, sf: str) -> DataFrame:
    return persisted(
        spark, sf, "stored1",
        lambda: merge.upsert(merge.empty_store(spark), flagged(spark, sf), fx.AS_OF_FIRST, eligible="eligible").drop("is_new"),
    )


def edits(spark: SparkSession, sf: str) -> DataFrame:
    return fx.edits(spark, sf, normalized(spark, sf))


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return persisted(
        spark, sf, "reviewed",
        lambda: merge.apply_edits(stored_first(spark, sf), edits(spark, sf), fx.AS_OF_EDITS).drop("edited"),
    )


def upserted_second(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(reviewed(spark, sf), flagged(spark, sf, 1), fx.AS_OF_SECOND, eligible="eligible")


def stored_second(spark: SparkSession, sf: str) -> DataFrame:
    return upserted_second(spark, sf).drop("is_new")


def ranked_postings(spark: SparkSession, sf: str, minimum_score: int = 35) -> DataFrame:
    rows = reviewed(spark, sf).filter(F.col("match_score") >= minimum_score)
    ranked = with_global_rank(rows, review_order(), key="entity_key", reads=REVIEW_READS)
    return ranked.select(
        "rank", "job_hash", "title", "company", "location", "url", "status", "match_score",
        "match_reason", "notes", iso_text("date_found").alias("date_found"),
        iso_text("last_seen").alias("last_seen"),
    )



# --- shared pieces ----------------------------------------------------------
FEED_MIN = 20
SHEET_MIN = 35
SLOTS = ("09:00", "12:00", "16:00", "20:00")
PURGE_PHRASES = (EXPORT_CONTROL_PHRASE, CLEARANCE_EXCLUSION_PHRASE, "Licensed under the Apache License")


def _iso(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, iso_text(c))
    return df


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Public feed rows with their stored review position ``feed_pos``."""

    def build():
        rows = reviewed(spark, sf).filter(F.col("match_score") >= FEED_MIN)
        ranked = with_global_rank(rows, review_order(), "feed_pos", key="entity_key", reads=REVIEW_READS)
        return P.public_feed(ranked, FEED_MIN, keep=("feed_pos", "entity_key"))

    return persisted(spark, sf, "feed", build)


def feed_with_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows with the doc id of their entity's last sighting (for fixture actions)."""
    b = scored(spark, sf).select(F.col("seq"), "entity_key")
    last = b.groupBy("entity_key").agg(F.max("seq").alias("seq"))
    return feed(spark, sf).join(last, "entity_key")


def action_map(spark: SparkSession, sf: str) -> DataFrame:
    f = feed_with_seq(spark, sf)
    return X.apply_actions(fx.actions(spark, sf, f))


# --- scalar functions --------------------------------------------------------
def clean_text(spark, sf):
    p = fx.postings(spark, sf)
    return p.select("seq", T.clean_text("title").alias("title_clean"), T.clean_text("description").alias("description_clean"))


def fold_text(spark, sf):
    p = fx.postings(spark, sf)
    return p.select("seq", T.fold_text("title").alias("title_fold"), T.fold_text("description").alias("description_fold"))


def html_text(spark, sf):
    pg = fx.table(spark, sf, "pages")
    return pg.select("page_id", html_to_text("html").alias("text"))


def normalize_url_q(spark, sf):
    pg = fx.table(spark, sf, "pages")
    return pg.select("page_id", "url", normalize_url("url").alias("url_norm"))


def url_domain_q(spark, sf):
    pg = fx.table(spark, sf, "pages")
    return pg.select("page_id", url_domain("url").alias("domain"))


def normalize_date_q(spark, sf):
    p = fx.postings(spark, sf)
    return p.select("seq", "date_posted", normalize_date("date_posted").alias("date_norm"))


def job_hash_q(spark, sf):
    return normalized(spark, sf).select("seq", "job_hash", "entity_key")


def next_slot_q(spark, sf):
    return fx.sightings(spark, sf).select("seq", next_slot("run_time", SLOTS).alias("next_slot"))


# --- predicates --------------------------------------------------------------
def us_locations(spark, sf):
    return normalized(spark, sf).select("seq", "location", E.is_us_location("location").alias("is_us"))


def us_names_only(spark, sf):
    return normalized(spark, sf).select(
        "seq", "location", E.is_us_location("location", mode="names_only").alias("is_us_ui")
    )


def internships(spark, sf):
    n = normalized(spark, sf)
    return n.select("seq", "employment_type", E.is_internship("title", "employment_type").alias("is_intern"))


def restricted_language(spark, sf):
    n = normalized(spark, sf)
    return n.select("seq", E.requires_clearance("title", "employment_type", "description").alias("needs_clearance"))


def eligible_postings(spark, sf):
    n = normalized(spark, sf)
    return E.eligible_only(n).select("seq", "job_hash", "title", "company", "location")


def keyword_hits(spark, sf):
    """(posting, rule) pairs with a whole-word hit and where it hit."""
    from ..operators.scoring import keyword_hits as hits

    n = normalized(spark, sf).select("seq", "title", "description")
    return hits(n, RULES, clean=True)


def score_threshold(spark, sf):
    return reviewed(spark, sf).filter(F.col("match_score") >= SHEET_MIN).select("job_hash", "match_score")


def phrase_purge(spark, sf):
    out = reviewed(spark, sf)
    for ph in PURGE_PHRASES:
        out = merge.phrase_purge(out, ph)
    return out.select("job_hash", "title")


def hash_purge(spark, sf):
    e = edits(spark, sf)
    doomed = e.filter(F.col("status") == "Rejected").select("job_hash")
    return merge.hash_purge(reviewed(spark, sf), doomed).select("job_hash", "title")


def legacy_store(spark, sf):
    """A store written without the eligibility filter (rows a later rule removes), with the verdicts of the run."""

    def build():
        rows = flagged(spark, sf)
        batch = E.with_verdict(score_postings(rows.drop("match_score", "match_reason"), RULES), "eligible").drop("eligible")
        return merge.upsert(merge.empty_store(spark), batch, fx.AS_OF_FIRST).drop("is_new")

    return persisted(spark, sf, "legacy", build)


def eligibility_purge(spark, sf):
    return merge.eligibility_purge(legacy_store(spark, sf)).select("job_hash", "location", "employment_type")


def search_feed(spark, sf):
    f = feed(spark, sf)
    return X.search_feed(f, query="The", location="us", minimum_score=35).select("job_hash", "title", "location")


def facet_filter(spark, sf):
    f = feed(spark, sf)
    return X.search_feed(f, company="src3", status="New", minimum_score=FEED_MIN).select("job_hash", "company", "status")


# --- projections -------------------------------------------------------------
def normalized_postings(spark, sf):
    return normalized(spark, sf)


def salary_text(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    lo = F.when(i % 4 == 0, F.lit(None)).otherwise((i % 50) * 1000).cast("bigint")
    hi = F.when(i % 3 == 0, F.lit(None)).otherwise((i % 50) * 1000 + 20000).cast("bigint")
    cur = F.when(i % 5 == 0, F.lit("USD")).when(i % 5 == 1, F.lit("")).when(i % 5 == 2, F.lit(None)).otherwise(F.lit("EUR"))
    return d.select("doc_id", S.salary_text(lo, hi, cur).alias("salary"))


def public_feed(spark, sf):
    return P.public_feed(reviewed(spark, sf), FEED_MIN)


def export_jobs_sheet(spark, sf):
    return P.jobs_sheet(reviewed(spark, sf), SHEET_MIN)


def job_keys(spark, sf):
    return X.with_keys(feed(spark, sf)).select("job_hash", "job_key", "legacy_key")


def display_rows(spark, sf):
    return X.display_rows(feed(spark, sf))


def safe_links(spark, sf):
    links = S.page_links(fx.table(spark, sf, "pages"))
    return links.select("page_id", "pos", "href", safe_link("href").alias("safe"))


def export_run_log(spark, sf):
    return P.run_log_sheet(_iso(fx.runs(spark, sf), "run_time"))


# --- joins / merge -------------------------------------------------------------
def upsert_postings(spark, sf):
    out = upserted_second(spark, sf)
    return _iso(out, "date_found", "last_seen", "updated_at").select(
        "job_hash", "entity_key", "title", "location", "status", "match_score", "notes",
        "date_found", "last_seen", "updated_at", "is_new",
    )


def apply_edits(spark, sf):
    out = merge.apply_edits(stored_first(spark, sf), edits(spark, sf), fx.AS_OF_EDITS)
    return _iso(out, "updated_at").select("job_hash", "status", "notes", "updated_at", "edited")


def edits_clean(spark, sf):
    return merge.clean_edits(edits(spark, sf))


def run_checks(spark, sf, as_of: str, shift: int = 0):
    """Source-check rows of one run: result text per enabled source."""
    src = fx.sources(spark, sf)
    fetched = U.enabled_sources(src).select(F.col("name").alias("source_name")).join(
        fx.postings(spark, sf, shift), "source_name"
    )
    errors = U.unsupported_sources(src)
    res = U.source_results(src, fetched, errors)
    return res.select(
        F.col("name").alias("source_name"),
        F.lit(as_of).cast("timestamp").alias("last_checked"),
        "last_result",
        F.lit(shift).cast("long").alias("seq"),
    )


def latest_checks(spark, sf):
    old = run_checks(spark, sf, fx.AS_OF_FIRST, 0)
    new = run_checks(spark, sf, fx.AS_OF_SECOND, 1)
    return _iso(merge.latest_checks(old, new), "last_checked", "updated_at")


def source_status(spark, sf):
    checks = merge.latest_checks(
        run_checks(spark, sf, fx.AS_OF_FIRST, 0), run_checks(spark, sf, fx.AS_OF_SECOND, 1)
    )
    return P.source_status(fx.sources(spark, sf), checks)


def source_results(spark, sf):
    return run_checks(spark, sf, fx.AS_OF_FIRST).select("source_name", "last_result")


def unsupported_sources(spark, sf):
    return U.unsupported_sources(fx.sources(spark, sf))


def union_sources(spark, sf):
    paths = landed(spark, sf)
    frames = [S.READERS[k](spark, paths[k]).select("source_name", "source_type", "title", "url") for k in KINDS]
    return S.union_sources(frames, fx.sources(spark, sf))


def review_buckets(spark, sf):
    f = feed(spark, sf)
    acts = X.migrate_actions(action_map(spark, sf), f)
    return X.review_buckets(f, acts).select("job_hash", "bucket")


def migrate_actions(spark, sf):
    return X.migrate_actions(action_map(spark, sf), feed(spark, sf))


def apply_actions(spark, sf):
    return action_map(spark, sf)


# --- aggregations ------------------------------------------------------------
def status_counts(spark, sf):
    return P.status_counts(reviewed(spark, sf))


def summary_metrics(spark, sf):
    return P.summary_metrics(reviewed(spark, sf), fx.AS_OF_SECOND, SLOTS)


def relevance_score(spark, sf):
    return scored(spark, sf).select("seq", "match_score")


def relevance_tokens(spark, sf):
    """The large-rule-set path (token equi-join + exact check) on the eligible postings."""
    from ..operators.scoring import rules_frame, score_by_tokens

    eligible = scored(spark, sf).select("seq", "title", "description")
    out = score_by_tokens(eligible, rules_frame(spark, RULES), key="seq")
    return out.select("seq", "match_score", "match_reason")


def match_reason(spark, sf):
    return scored(spark, sf).select("seq", "match_reason")


def run_stats(spark, sf):
    src = fx.sources(spark, sf)
    fetched = U.enabled_sources(src).select(F.col("name").alias("source_name")).join(fx.postings(spark, sf), "source_name")
    errors = U.unsupported_sources(src).join(src.select("name", "pos"), "name")
    upserted = merge.upsert(merge.empty_store(spark), merge.prepare_batch(fetched, RULES), fx.AS_OF_FIRST)
    return U.run_stats(src, fetched, errors, upserted)


def feed_summary(spark, sf):
    return X.feed_summary(feed(spark, sf))


def facets(spark, sf):
    f = feed(spark, sf)
    return X.facets(f, "company").unionByName(X.facets(f, "status"))


def bucket_counts(spark, sf):
    f = feed(spark, sf)
    return X.bucket_counts(X.review_buckets(f, X.migrate_actions(action_map(spark, sf), f)))


def change_counts(spark, sf):
    """Affected rows per step of the two runs; each table is read once, all counts of a table in one aggregate."""
    st1 = stored_first(spark, sf)
    doomed = reduce(lambda a, b: a | b, [F.coalesce(merge.phrase_predicate(ph), F.lit(False)) for ph in PURGE_PHRASES])
    second = ~F.col("is_new") & (F.col("updated_at") == F.lit(fx.AS_OF_SECOND).cast("timestamp"))
    legacy = legacy_store(spark, sf)
    parts = [
        st1.agg(F.count(F.lit(1)).alias("inserted_run1")),
        merge.edits_that_hit(st1, edits(spark, sf)).agg(F.count(F.lit(1)).alias("edits_applied")),
        upserted_second(spark, sf).agg(F.count_if(F.col("is_new")).alias("inserted_run2"), F.count_if(second).alias("updated_run2")),
        reviewed(spark, sf).agg(F.count_if(doomed).alias("phrase_deleted")),
        legacy.agg(F.count_if(~E.still_eligible(legacy)).alias("eligibility_deleted")),
    ]
    named = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("count")) for c in df.columns])).alias("x")).select("x.*") for df in parts]
    return reduce(DataFrame.unionByName, named)


def feed_manifest(spark, sf):
    return P.feed_manifest(P.public_feed(reviewed(spark, sf), FEED_MIN), FEED_MIN, fx.AS_OF_SECOND)


def skipped_postings(spark, sf):
    return U.skipped_postings(normalized(spark, sf))


# --- windows -------------------------------------------------------------------
def batch_collapse(spark, sf):
    return merge.collapse_batch(scored(spark, sf)).select(
        "entity_key", "job_hash", "first_seq", "last_seq", "sightings", "title", "match_score"
    )


def request_admission(spark, sf):
    return R.request_admission(fx.requests(spark, sf), max_total=120).select("seq", "domain", "granted", "decision")


def backoff_delays(spark, sf):
    return R.backoff_delays(fx.requests(spark, sf)).select("seq", "domain", "attempt", "delay_seconds")


def pacing_shortfall(spark, sf):
    return R.pacing_shortfall(fx.requests(spark, sf)).select("seq", "domain", "gap_seconds", "shortfall_seconds")


def response_classes(spark, sf):
    return R.response_classes(fx.requests(spark, sf)).select("seq", "status_code", "response_class")


def expired_snapshots(spark, sf):
    manifest = fx.runs(spark, sf).select(F.unix_seconds("run_time").alias("version"))
    return K.expired_snapshots(manifest, SNAPSHOTS_KEPT)


def first_last_seen(spark, sf):
    out = merge.first_last_seen(fx.sightings(spark, sf))
    return _iso(out, "first_seen", "last_seen")


# --- sorts ---------------------------------------------------------------------
def sorted_feed(spark, sf):
    return X.sorted_feed(feed(spark, sf), "score").select("job_hash", "sort_pos")


def sorted_feed_company(spark, sf):
    return X.sorted_feed(feed(spark, sf), "company").select("job_hash", "company", "sort_pos")


def sorted_feed_newest(spark, sf):
    return X.sorted_feed(feed(spark, sf), "newest").select("job_hash", "date_found", "sort_pos")


def sorted_feed_title(spark, sf):
    return X.sorted_feed(feed(spark, sf), "title").select("job_hash", "title", "sort_pos")


def html_links(spark, sf):
    return S.html_links(fx.table(spark, sf, "pages"))


# --- sources, sinks, streams ------------------------------------------------------
def landed(spark, sf, kinds: tuple[str, ...] = KINDS) -> dict:
    """Landed payload folders of ``kinds`` (each written once per session from the postings fixture)."""
    from ..sources import landing

    app = spark.sparkContext.applicationId
    with _BUILD_LOCK:
        missing = [k for k in kinds if (app, sf, f"landed-{k}") not in _WRITTEN]
        if missing:
            tag = hashlib.sha1(f"{app}|{sf}".encode()).hexdigest()[:12]
            root = os.path.join(work_dir(spark, "landed"), tag)
            paths = landing.land_payloads(fx.postings(spark, sf), fx.sources(spark, sf), root, missing)
            _WRITTEN.update({(app, sf, f"landed-{k}"): path for k, path in paths.items()})
        return {k: _WRITTEN[app, sf, f"landed-{k}"] for k in kinds}


def _scan(kind):
    def run(spark, sf):
        raw = S.READERS[kind](spark, landed(spark, sf, (kind,))[kind])
        return S.with_company(raw, fx.sources(spark, sf)).select(*[c for c in S.RAW_COLUMNS if c not in ("seq", "raw_data")])

    run.__name__ = f"scan_{kind}"
    return run


def quarantine(spark, sf):
    paths = landed(spark, sf)
    return reduce(DataFrame.unionByName, [S.quarantine(spark, paths[k], k) for k in KINDS])


def raw_json(spark, sf):
    raw = S.read_ashby(spark, landed(spark, sf, ("ashby",))["ashby"])
    return raw.select("source_name", "title", "raw_data")


def feed_scan(spark, sf):
    """The public feed written as an envelope of JSON Lines parts plus a manifest, read back."""
    root = fresh_dir(spark, "feed")
    f = feed(spark, sf).drop("feed_pos", "entity_key")
    manifest = P.feed_manifest(f, FEED_MIN, fx.AS_OF_SECOND)
    K.publish_feed(f, manifest, root)
    K.publish_feed(f, manifest, root)  # unchanged: the folder that is live stays
    return S.read_feed(spark, root)


def run_log_append(spark, sf):
    path = fresh_dir(spark, "run_log")
    runs = fx.runs(spark, sf)
    K.append_run_log(runs.filter(F.col("run_time") < F.lit("2024-01-15").cast("timestamp")), path)
    K.append_run_log(runs.filter(F.col("run_time") >= F.lit("2024-01-15").cast("timestamp")), path)
    return _iso(spark.read.parquet(path), "run_time")


def snapshot_write(spark, sf):
    """Three writes of the stored table: v1, v2 (changed), an unchanged write (skipped)."""
    root = fresh_dir(spark, "snapshots")
    versions = [
        K.write_snapshot(stored_first(spark, sf), root),
        K.write_snapshot(reviewed(spark, sf), root),
        K.write_snapshot(reviewed(spark, sf), root),
    ]
    current = K.read_current(spark, root)
    return current.withColumn("version", F.lit(versions[-1])).select("version", "job_hash", "status")


def snapshot_changed(spark, sf):
    """Rows of three successive snapshots and whether each differs from the one before (checksums, whatever the order)."""
    a = K.content_checksum(stored_first(spark, sf)).withColumn("snapshot", F.lit("1 stored"))
    b = K.content_checksum(reviewed(spark, sf)).withColumn("snapshot", F.lit("2 reviewed"))
    c = K.content_checksum(reviewed(spark, sf).orderBy("title")).withColumn("snapshot", F.lit("3 reordered"))
    sums = F.struct("rows", "checksum", "checksum2")
    before = F.lag(sums).over(Window.orderBy("snapshot"))  # three rows
    return a.unionByName(b).unionByName(c).select("snapshot", "rows", F.coalesce(sums != before, F.lit(True)).alias("changed"))


def stream_ingest(spark, sf):
    from ..streaming.ingest import stream_ingest as run

    base = fresh_dir(spark, "stream_ingest")
    out = run(spark, landed(spark, sf, ("lever",))["lever"], os.path.join(base, "table"), os.path.join(base, "checkpoint"), RULES,
              merge_every=4, sources=fx.sources(spark, sf))
    # sighting times depend on which files each micro-batch picked up; the streaming
    # tests check them against batch-by-batch merging
    return out.select(
        "job_hash", "entity_key", "title", "company", "location", "url", "source_name", "source_type", "description", "salary",
        "employment_type", "date_posted", "status", "notes", "match_score", "match_reason",
    )


def merge_buckets(spark, sf):
    """The second sighting merged into a store of 32 buckets; the whole table read back."""
    root = fresh_dir(spark, "buckets")
    B.create(reviewed(spark, sf), root, 32)
    B.merge_batch(spark, root, flagged(spark, sf, 1), fx.AS_OF_SECOND, "second", eligible="eligible")
    return _iso(B.read(spark, root), "date_found", "last_seen", "updated_at").select(
        "job_hash", "entity_key", "title", "location", "status", "match_score", "notes", "date_found", "last_seen", "updated_at"
    )


def stream_first_last_seen(spark, sf):
    from ..streaming.ingest import running_first_last_seen

    base = fresh_dir(spark, "stream_seen")
    # the events as they would arrive: several files, each a micro-batch of its own
    arrived = os.path.join(base, "arrived")
    fx.table(spark, sf, "events").repartition(4, "event_id").write.parquet(arrived)
    return _iso(running_first_last_seen(spark, arrived, base, file_glob="*.parquet"), "first_seen", "last_seen")


def sheet_round_trip(spark, sf):
    """Export the review sheet as CSV, read it back as edits, apply them."""
    path = fresh_dir(spark, "sheet")
    store = reviewed(spark, sf)
    P.write_jobs_sheet_csv(store, path, SHEET_MIN)
    out = merge.apply_edits(store, S.read_edits_csv(spark, path), fx.AS_OF_SECOND)
    return out.select("job_hash", "status", "notes", "edited")


def workflow_run(spark, sf):
    """Two complete runs over the landed payloads (edits applied before the second)."""
    from . import workflow

    root = fresh_dir(spark, "workflow")
    src = fx.sources(spark, sf)
    paths = landed(spark, sf)
    first = workflow.run(spark, root, src, paths, RULES, fx.AS_OF_FIRST)
    e = first.store.select(
        F.lit(1).cast("long").alias("seq"), "job_hash", F.lit("").alias("url"),
        F.lit("Interested").alias("status"), F.lit("seen").alias("notes"),
    ).filter(F.col("match_score") >= 60)
    second = workflow.run(spark, root, src, paths, RULES, fx.AS_OF_SECOND, edits=e, old_checks=first.checks)
    return _iso(second.store, "date_found", "last_seen", "updated_at").select(
        "job_hash", "title", "company", "location", "status", "notes", "match_score", "date_found", "last_seen"
    )


def recent_run_logs(spark, sf):
    return _iso(P.recent_run_logs(fx.runs(spark, sf), 200), "run_time")


REGISTRY = {
    "ranked_postings": ranked_postings,
    "clean_text": clean_text,
    "fold_text": fold_text,
    "html_text": html_text,
    "normalize_url": normalize_url_q,
    "url_domain": url_domain_q,
    "normalize_date": normalize_date_q,
    "job_hash": job_hash_q,
    "next_slot": next_slot_q,
    "us_locations": us_locations,
    "us_names_only": us_names_only,
    "internships": internships,
    "restricted_language": restricted_language,
    "eligible_postings": eligible_postings,
    "keyword_hits": keyword_hits,
    "score_threshold": score_threshold,
    "phrase_purge": phrase_purge,
    "hash_purge": hash_purge,
    "eligibility_purge": eligibility_purge,
    "search_feed": search_feed,
    "normalized_postings": normalized_postings,
    "salary_text": salary_text,
    "public_feed": public_feed,
    "export_jobs_sheet": export_jobs_sheet,
    "job_keys": job_keys,
    "display_rows": display_rows,
    "safe_links": safe_links,
    "export_run_log": export_run_log,
    "upsert_postings": upsert_postings,
    "merge_buckets": merge_buckets,
    "apply_edits": apply_edits,
    "edits_clean": edits_clean,
    "latest_checks": latest_checks,
    "source_status": source_status,
    "source_results": source_results,
    "unsupported_sources": unsupported_sources,
    "union_sources": union_sources,
    "review_buckets": review_buckets,
    "migrate_actions": migrate_actions,
    "apply_actions": apply_actions,
    "status_counts": status_counts,
    "summary_metrics": summary_metrics,
    "relevance_score": relevance_score,
    "match_reason": match_reason,
    "relevance_tokens": relevance_tokens,
    "run_stats": run_stats,
    "feed_summary": feed_summary,
    "facets": facets,
    "bucket_counts": bucket_counts,
    "change_counts": change_counts,
    "feed_manifest": feed_manifest,
    "skipped_postings": skipped_postings,
    "batch_collapse": batch_collapse,
    "request_admission": request_admission,
    "backoff_delays": backoff_delays,
    "pacing_shortfall": pacing_shortfall,
    "response_classes": response_classes,
    "expired_snapshots": expired_snapshots,
    "first_last_seen": first_last_seen,
    "sorted_feed": sorted_feed,
    "sorted_feed_company": sorted_feed_company,
    "sorted_feed_newest": sorted_feed_newest,
    "sorted_feed_title": sorted_feed_title,
    "facet_filter": facet_filter,
    "recent_run_logs": recent_run_logs,
    "html_links": html_links,
    "scan_lever": _scan("lever"),
    "scan_ashby": _scan("ashby"),
    "scan_greenhouse": _scan("greenhouse"),
    "scan_html": _scan("html"),
    "quarantine": quarantine,
    "raw_json": raw_json,
    "feed_scan": feed_scan,
    "run_log_append": run_log_append,
    "snapshot_write": snapshot_write,
    "snapshot_changed": snapshot_changed,
    "stream_ingest": stream_ingest,
    "stream_first_last_seen": stream_first_last_seen,
    "workflow_run": workflow_run,
    "sheet_round_trip": sheet_round_trip,
}
