"""Batch merge into the stored postings table, edits, purges.

The stored table is a DataFrame (a Parquet snapshot on disk, see
``snapshots``).  One batch is merged set-at-a-time:

1. ``collapse_batch`` — one row per ``entity_key`` (first row fixes the
   hash, last row wins the other fields).  Counts and the first hash come from an
   aggregation of narrow columns; the winning row is the first of a window, whose group
   limit works before the shuffle too, so a hot key costs one row per map task.
2. ``upsert`` — one full outer equi-join of stored and batch on
   ``entity_key``; both sides hold one row per key after step 1, so the join
   cannot fan out whatever the key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_STATUS, STATUSES
from ..functions.dates import normalize_date
from ..functions.identity import entity_key, job_hash
from ..functions.text import clean_text, fold_cleaned
from ..functions.urls import normalize_url
from ..session import checkpoint_dir
from .eligibility import VERDICT, VERDICT_TYPE, eligible_folded, still_eligible
from .ordering import broadcast_if_light
from .scoring import Rule, score_postings

SOURCE_FIELDS = (
    "title",
    "company",
    "location",
    "url",
    "source_name",
    "source_type",
    "description",
    "salary",
    "employment_type",
    "date_posted",
    "raw_data",
)
STORED_SCHEMA = T.StructType(
    [T.StructField("job_hash", T.StringType()), T.StructField("entity_key", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in SOURCE_FIELDS]
    + [
        T.StructField("date_found", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("match_score", T.IntegerType()),
        T.StructField("match_reason", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
STORED_COLUMNS = tuple(f.name for f in STORED_SCHEMA.fields)


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORED_SCHEMA)


def as_timestamp(value) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(value).cast("timestamp")


def normalize_postings(df: DataFrame) -> DataFrame:
    """Clean text fields, normalise URL and date, add ``job_hash`` and ``entity_key``."""
    keep = [c for c in df.columns if c not in SOURCE_FIELDS]
    raw = F.col("raw_data").cast("string") if "raw_data" in df.columns else F.lit("{}")
    out = df.select(
        *keep,
        clean_text("title").alias("title"),
        clean_text("company").alias("company"),
        clean_text("location").alias("location"),
        normalize_url("url").alias("url"),
        F.coalesce(F.col("source_name"), F.lit("")).alias("source_name"),
        F.coalesce(F.col("source_type"), F.lit("")).alias("source_type"),
        clean_text("description").alias("description"),
        clean_text("salary").alias("salary"),
        clean_text("employment_type").alias("employment_type"),
        normalize_date("date_posted").alias("date_posted"),
        F.coalesce(raw, F.lit("{}")).alias("raw_data"),
    )
    out = out.withColumn("job_hash", job_hash("title", "company", "url", "location"))
    return out.withColumn("entity_key", entity_key("url", "job_hash"))


def flag_batch(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Normalise, flag eligibility, score eligible rows (the per-posting part of a run).

    Every row is kept with an ``eligible`` flag; score and reason are NULL
    for ineligible rows and no rule is evaluated for them.  Nothing filters
    on a derived column here: a filter would be pushed below the projection
    and re-evaluate the text cleaning and folding inside it.
    """
    norm = normalize_postings(df)
    f = (
        norm.withColumn("_ft", fold_cleaned("title"))
        .withColumn("_fe", fold_cleaned("employment_type"))
        .withColumn("_fd", fold_cleaned("description"))
    )
    f = f.withColumn("eligible", eligible_folded("location", "_ft", "_fe", "_fd"))
    scored = score_postings(f, rules, title="_ft", description="_fd", folded=True, only_if="eligible")
    return scored.drop("_ft", "_fe", "_fd")


def prepare_batch(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Eligible rows of ``flag_batch`` (normalised and scored)."""
    return flag_batch(df, rules).filter(F.col("eligible")).drop("eligible")


def collapse_batch(
    batch: DataFrame,
    order: str = "seq",
    eligible: str | None = None,
    keep_ineligible: bool = False,
    time: str | None = None,
) -> DataFrame:
    """One row per entity_key: first row's hash, last row's other fields.

    With ``eligible`` (a flag column) ineligible rows count nowhere; they are left out before anything is
    shuffled, as an entity without an eligible row has none in the result.
    ``keep_ineligible`` keeps entities whose sightings are all ineligible (ineligible rows lose to eligible ones) and
    adds ``newest_eligible`` (the flag of the entity's latest sighting).
    ``time`` names a per-row sighting time: ``first_time`` / ``last_time`` of
    the entity's first and last (eligible) sightings are added.

    Rows without an order come first; among rows of equal order the smallest hash
    comes first and the row with the largest content hash wins. Descriptions and other wide fields are
    shuffled once, by the window; they enter no aggregate.
    """
    from pyspark.sql import Window

    live = F.coalesce(F.col(eligible), F.lit(False)) if eligible else F.lit(True)
    if eligible and not keep_ineligible:
        batch, live = batch.filter(live), F.lit(True)
    at = lambda *cols: F.when(live, F.struct(F.col(order), *cols))  # noqa: E731  not null even where the order is
    aggs = [
        F.min_by("job_hash", at(F.col("job_hash"))).alias("job_hash"),
        F.min(F.when(live, F.col(order))).alias("first_seq"),
        F.max(F.when(live, F.col(order))).alias("last_seq"),
        F.count_if(live).alias("sightings"),
    ]
    extra = []
    if eligible and keep_ineligible:
        aggs.append(F.max_by(live, F.struct(F.col(order), live)).alias("newest_eligible"))
        extra.append("newest_eligible")
    if time:
        aggs += [F.min_by(F.col(time), at(F.col(time))).alias("first_time"), F.max_by(F.col(time), at(F.col(time))).alias("last_time")]
        extra += ["first_time", "last_time"]
    narrow = batch.groupBy("entity_key").agg(*aggs)

    fields = [c for c in batch.columns if c not in ("entity_key", "job_hash", order, eligible, time)]
    newest = Window.partitionBy("entity_key").orderBy(live.desc(), F.col(order).desc_nulls_last(), F.xxhash64(*fields).desc())
    wide = batch.select("entity_key", *fields, F.row_number().over(newest).alias("_nth")).filter(F.col("_nth") == 1).drop("_nth")
    return wide.join(narrow, "entity_key").select("entity_key", "job_hash", "first_seq", "last_seq", "sightings", *extra, *fields)


def upsert(
    stored: DataFrame,
    batch: DataFrame,
    as_of,
    collapse: bool = True,
    eligible: str | None = None,
    expire_ineligible: bool = False,
    order: str = "seq",
    time: str | None = None,
) -> DataFrame:
    """Merge a scored batch into the stored table; returns the new table plus ``is_new``.

    Inserts get date_found = last_seen = created_at = updated_at = as_of,
    status 'New', notes ''.  Updates refresh the source fields, score,
    reason, last_seen and updated_at and never touch job_hash, status,
    notes, date_found or created_at.

    A ``verdict`` column of either side (see ``eligibility.with_verdict``) goes with the text it
    was made from.

    By default a stored row whose newest sighting is ineligible is kept as
    stored (the sighting is skipped).  ``expire_ineligible=True`` (needs
    ``eligible``) drops such rows instead.

    ``time`` merges several batches at once: each row carries its own
    sighting time, inserts take the first sighting's time and updates the
    last one's (``as_of`` is then unused), which equals merging the batches
    one after the other in ``order``.
    """
    expire = bool(expire_ineligible and eligible)
    memo = [VERDICT] if VERDICT in batch.columns or VERDICT in stored.columns else []

    def with_memo(df: DataFrame) -> DataFrame:
        return df if not memo or VERDICT in df.columns else df.withColumn(VERDICT, F.lit(None).cast(VERDICT_TYPE))

    stored, batch = with_memo(stored), with_memo(batch)
    b = collapse_batch(batch, order=order, eligible=eligible, keep_ineligible=expire, time=time) if collapse else batch
    b = b.select(
        "entity_key",
        "job_hash",
        *SOURCE_FIELDS,
        "match_score",
        "match_reason",
        *memo,
        (F.col("sightings") > 0 if expire else F.lit(True)).alias("_in_batch"),
        (~F.col("newest_eligible") if expire else F.lit(False)).alias("_expire"),
        (F.col("first_time") if time else as_timestamp(as_of)).alias("_t_first"),
        (F.col("last_time") if time else as_timestamp(as_of)).alias("_t_last"),
    )
    s = stored.select(*STORED_COLUMNS, *memo).withColumn("_in_store", F.lit(True))
    j = s.alias("s").join(b.alias("b"), "entity_key", "full_outer")
    hit = F.coalesce(F.col("b._in_batch"), F.lit(False))
    old = F.coalesce(F.col("s._in_store"), F.lit(False))
    if expire:
        # drop expired rows, and entities seen only in ineligible sightings that are not stored
        j = j.filter(~F.coalesce(F.col("b._expire"), F.lit(False)) & (old | hit))

    def fresh(c: str) -> Column:
        return F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    cols = [
        F.coalesce(F.col("s.job_hash"), F.col("b.job_hash")).alias("job_hash"),
        F.col("entity_key"),
        *[fresh(c) for c in SOURCE_FIELDS],
        F.when(old, F.col("s.date_found")).otherwise(F.col("b._t_first")).alias("date_found"),
        F.when(hit, F.col("b._t_last")).otherwise(F.col("s.last_seen")).alias("last_seen"),
        F.when(old, F.col("s.status")).otherwise(F.lit(DEFAULT_STATUS)).alias("status"),
        fresh("match_score"),
        fresh("match_reason"),
        F.when(old, F.col("s.notes")).otherwise(F.lit("")).alias("notes"),
        F.when(old, F.col("s.created_at")).otherwise(F.col("b._t_first")).alias("created_at"),
        F.when(hit, F.col("b._t_last")).otherwise(F.col("s.updated_at")).alias("updated_at"),
        *[fresh(c) for c in memo],
        (~old).alias("is_new"),
    ]
    return j.select(*cols)


def clean_edits(edits: DataFrame) -> DataFrame:
    """Blank status -> 'New', blank notes -> '', URL normalised; absent columns tolerated."""
    def have(c: str) -> Column:
        return F.col(c).cast("string") if c in edits.columns else F.lit(None).cast("string")

    status = F.coalesce(F.when(have("status") != "", have("status")), F.lit(DEFAULT_STATUS))
    return edits.select(
        F.col("seq"),
        F.coalesce(have("job_hash"), F.lit("")).alias("job_hash"),
        normalize_url(have("url")).alias("url"),
        status.alias("status"),
        F.coalesce(have("notes"), F.lit("")).alias("notes"),
    )


def edits_by_row(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """(entity_key, status, notes): the edit that each edited row ends with.

    Only keys of the stored table are read and joined. Edits are reduced to one per hash or URL before they
    meet the table, so a hot key stays one row; rows without a URL take part in the join by hash only.
    """
    e = clean_edits(edits).filter(F.col("status").isin(*STATUSES))
    last = F.max_by(F.struct("status", "notes"), F.struct("seq", "status", "notes")).alias("edit")
    by_hash = e.filter(F.col("job_hash") != "").groupBy("job_hash").agg(F.max("seq").alias("seq"), last)
    by_url = e.filter((F.col("job_hash") == "") & (F.col("url") != "")).groupBy("url").agg(F.max("seq").alias("seq"), last)
    keys = stored.select("entity_key", "job_hash", "url")
    found = keys.join(by_hash, "job_hash").select("entity_key", "seq", F.lit(1).alias("by"), "edit")
    found = found.unionByName(keys.filter(F.col("url") != "").join(by_url, "url").select("entity_key", "seq", F.lit(0).alias("by"), "edit"))
    # the later edit wins, one by hash over one by URL of the same place
    return found.groupBy("entity_key").agg(F.max_by("edit", F.struct("seq", "by")).alias("e")).select("entity_key", "e.status", "e.notes")


def apply_edits(stored: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """Human edits of status / notes: by hash when the edit has one, else by URL.

    An invalid status rejects the whole edit.  Several edits of one row: the
    last (largest ``seq``) wins.  Edits are resolved to rows on narrow columns first; the wide table is
    joined once, on its unique key, with one row per edited row. That side is pinned and broadcast where its size
    is proven small, so the wide rows stay where they are.
    """
    e = edits_by_row(stored, edits).select(F.col("entity_key").alias("_key"), F.col("status").alias("_status"), F.col("notes").alias("_notes"))
    checkpoint_dir(e.sparkSession)
    e = broadcast_if_light(e.checkpoint(eager=True))
    j = stored.join(e, F.col("entity_key") == F.col("_key"), "left")
    edited = F.col("_key").isNotNull()
    new = {"status": F.col("_status"), "notes": F.col("_notes"), "updated_at": as_timestamp(as_of)}
    out = [F.when(edited, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns]
    return j.select(*out, edited.alias("edited"))


def edits_that_hit(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Edit rows that changed at least one stored row (the import count)."""
    e = clean_edits(edits).filter(F.col("status").isin(*STATUSES))
    hashes = stored.select("job_hash").filter(F.col("job_hash") != "")
    urls = stored.select("url").filter(F.col("url") != "")
    h = e.filter(F.col("job_hash") != "").join(hashes, "job_hash", "left_semi")
    u = e.filter((F.col("job_hash") == "") & (F.col("url") != "")).join(urls, "url", "left_semi")
    return h.unionByName(u)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def phrase_predicate(text: str) -> Column:
    """title / description / reason contain ``text`` (ASCII case-insensitive,
    with ``%`` and ``_`` in ``text`` acting as wildcards)."""
    folded = text.translate(str.maketrans(_UPPER, _LOWER))
    pattern = F.lit("%" + folded + "%")
    esc = "\u0001"

    def test(c: str) -> Column:
        found = F.like(_ascii_lower(F.col(c)), pattern, F.lit(esc))
        # lower case takes ASCII letters where _ascii_lower does: a cheap necessary condition for plain ASCII text
        plain = folded.isascii() and not set(folded) & set("%_" + esc)
        return F.contains(F.lower(F.col(c)), F.lit(folded)) & found if plain else found

    tests = [test(c) for c in ("title", "description", "match_reason")]
    return tests[0] | tests[1] | tests[2]


def phrase_purge(stored: DataFrame, text: str) -> DataFrame:
    """Rows kept after deleting those that contain ``text`` (NULL never deletes)."""
    return stored.filter(~F.coalesce(phrase_predicate(text), F.lit(False)))


def hash_purge(stored: DataFrame, doomed: DataFrame, broadcast_limit: int = 1_000_000) -> DataFrame:
    """Anti-join delete by a list of hashes; blank hashes are ignored.

    The doomed list is broadcast only when its row count is below the limit.
    """
    d = doomed.select("job_hash").filter(F.col("job_hash") != "").distinct()
    n = d.limit(broadcast_limit + 1).count()
    side = F.broadcast(d) if n <= broadcast_limit else d
    return stored.join(side, "job_hash", "left_anti")


def eligibility_purge(stored: DataFrame) -> DataFrame:
    """Stored rows that still pass eligibility.

    A row whose ``verdict`` was made by the present rules from its present text is taken at that; the
    patterns are evaluated on the others only.
    """
    return stored.filter(still_eligible(stored))


def first_last_seen(sightings: DataFrame, key: str = "entity", ts: str = "run_time") -> DataFrame:
    return sightings.groupBy(key).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("sightings")
    )


def latest_checks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Source-check upsert: latest result per source name (later ``seq`` breaks ties)."""
    u = old.select("source_name", "last_checked", "last_result", "seq").unionByName(
        new.select("source_name", "last_checked", "last_result", "seq")
    )
    return u.groupBy("source_name").agg(
        F.max_by(F.struct("last_checked", "last_result"), F.struct("last_checked", "seq")).alias("c")
    ).select(
        "source_name",
        F.col("c.last_checked").alias("last_checked"),
        F.col("c.last_result").alias("last_result"),
        F.col("c.last_checked").alias("updated_at"),
    )
