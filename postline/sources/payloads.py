"""Source readers: landed JSON payloads (three board formats) and HTML pages.

Every reader returns the common raw posting shape
``(seq, title, company, location, url, source_name, source_type,
description, salary, employment_type, date_posted, raw_data)``; the landed
files of one source live under ``<root>/<source_name>/`` so the source name
comes from the path, not from the payload.

Readers take payloads as text and each posting as VARIANT, never by inference.
A payload that is not of the expected shape becomes a quarantine row, and so
does a single posting with a field of another shape; its neighbours are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import attributes, decode_each, html_to_text, is_markup, tokens
from ..functions.text import clean_text, first_truthy, let, nonempty, strip_text
from ..functions.urls import resolve_url
from ..operators.ordering import broadcast_if_small

RAW_COLUMNS = (
    "seq", "title", "company", "location", "url", "source_name", "source_type",
    "description", "salary", "employment_type", "date_posted", "raw_data",
)

S = T.StringType()

# fixed values: the fields read from a posting, by the shape they must have ("text": any scalar)
FIELDS = {
    "lever": {
        "text": ("text", "hostedUrl", "applyUrl", "descriptionPlain", "description", "additionalPlain", "additional", "createdAt",
                 "categories.location", "categories.commitment", "salaryRange.min", "salaryRange.max", "salaryRange.currency"),
        "OBJECT": ("categories", "salaryRange"),
    },
    "ashby": {"text": ("title", "location.name", "jobUrl", "applyUrl", "descriptionHtml", "description", "employmentType", "publishedAt")},
    "greenhouse": {"text": ("title", "location.name", "absolute_url", "content", "updated_at"), "OBJECT": ("location",), "ARRAY": ("offices",)},
}


def salary_text(lo, hi, currency) -> Column:
    """'min - max' skipping missing values (0 kept), then ' CUR'; currency alone allowed."""
    rng = F.concat_ws(" - ", lo.cast("string"), hi.cast("string"))
    cur = F.coalesce(currency, F.lit(""))
    return F.trim(F.when(cur != "", F.concat_ws(" ", nonempty(rng), cur)).otherwise(rng))


def _with_source(df: DataFrame) -> DataFrame:
    """Source name from the landed layout: ``<root>/source_name=<name>/...``
    (partition discovery) or ``<root>/<name>/<file>``."""
    named = "source_name" in df.columns
    # where a line is from, whatever files a task reads: the order of payloads rests on it
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    df = df.select("*", place.alias("place"))
    if named:
        return df.withColumn("source_name", F.col("source_name").cast("string"))
    return df.withColumn("source_name", F.regexp_extract("place.file", r"/([^/]+)/[^/]+$", 1))


def _seq(lines: DataFrame) -> Column:
    """Order of rows exploded from lines: file, block and the position there (ids grow within a block, however blocks are packed)."""
    row = F.monotonically_increasing_id()  # right after the explode: no shuffle before
    return F.struct("place.file", "place.start", row.alias("row")) if "place" in lines.columns else row


def payload_lines(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """Landed payloads as text: one per line, or with ``multi_line`` one per file."""
    return _with_source(spark.read.text(root, wholetext=multi_line)).filter(F.trim("value") != "")


def _opens(text: str, mark: str) -> Column:
    """Whether JSON text that can be parsed is an object ('{') or an array ('[')."""
    return F.startswith(F.ltrim(F.col(text), F.lit(" \t\n\r")), F.lit(mark))


def _well_shaped(kind: str) -> Column:
    """Lever payloads are a JSON array, landed pages an object with text ``url`` and ``html``;
    the others an object whose ``jobs`` (when present) is an array."""

    def shaped(v: Column) -> Column:
        if kind == "html":
            text = [F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.lit(False)) for k in ("url", "html")]
            return v.isNotNull() & _opens("value", "{") & text[0] & text[1] & (F.trim(F.try_variant_get(v, "$.url", "string")) != "")
        if kind == "lever":
            return v.isNotNull() & _opens("value", "[")
        jobs = F.try_variant_get(v, "$.jobs", "variant")
        # read as an array, not by its schema: that would be merged over all postings
        listed = F.is_variant_null(jobs) | F.try_variant_get(v, "$.jobs", "array<variant>").isNotNull()
        return v.isNotNull() & _opens("value", "{") & (jobs.isNull() | listed)

    return let(F.try_parse_json(F.col("value")), shaped)  # a payload is parsed once


def items(lines: DataFrame, kind: str) -> DataFrame:
    """(source_name, seq, raw, item, faults): every posting of the well-shaped payloads, in payload order.

    ``raw`` is the posting's JSON text with all its fields, ``item`` the same as
    VARIANT, ``faults`` the fields whose shape can't be read (or 'not an object').
    A fault stays with its posting; the others of the payload are not touched.
    """
    if kind == "lever":
        postings = F.from_json("value", "array<string>")
    else:
        postings = F.from_json("value", "struct<jobs: array<string>>")["jobs"]
    place = [c for c in lines.columns if c == "place"]
    one = lines.select("source_name", *place, F.posexplode(F.when(_well_shaped(kind), postings)).alias("pos", "raw"))
    # what a generator makes is made once: a filter on it isn't moved below, to parse the posting again
    one = one.select("source_name", _seq(lines).alias("seq"), "raw").select("*", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("item")))))

    def fault(path: str, want: str) -> Column:
        shape = F.schema_of_variant(F.try_variant_get("item", f"$.{path}", "variant"))
        bad = shape.startswith("OBJECT") | shape.startswith("ARRAY") if want == "text" else ~(shape.startswith(want) | shape.startswith("VOID"))
        return F.when(bad, F.lit(path))

    every = F.array_compact(F.array(*[fault(path, want) for want, paths in FIELDS[kind].items() for path in paths]))
    whole = F.col("item").isNotNull() & _opens("raw", "{")
    return one.withColumn("faults", F.when(whole, every).otherwise(F.array(F.lit("not an object"))))


def _text(path: str) -> Column:
    """A scalar of the posting as text (numbers as written), NULL when absent or of another shape."""
    v = F.try_variant_get("item", f"$.{path}", "variant")
    return F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.try_variant_get("item", f"$.{path}", "string"))


def _readable(rows: DataFrame, kind: str) -> DataFrame:
    """The postings without a fault, their text fields as columns named by path (so each is read once).

    None of these fields is of another shape, that would be a fault.
    """
    text = [F.try_variant_get("item", f"$.{p}", "string").alias(p) for p in FIELDS[kind]["text"]]
    return rows.filter(F.size("faults") == 0).select("source_name", "seq", "raw", "item", *text)


def _f(path: str) -> Column:
    return F.col(f"`{path}`")


def lever_rows(rows: DataFrame) -> DataFrame:
    """Raw posting rows of Lever items; the batch reader and the stream share it."""
    # columns of their own: nonempty() names its text twice, and markup is read once this way
    texts = _readable(rows, "lever").select(
        "*",
        F.coalesce(nonempty(_f("descriptionPlain")), html_to_text(_f("description"))).alias("_plain"),
        html_to_text(first_truthy(_f("additionalPlain"), _f("additional"))).alias("_more"),
    )
    desc = F.concat_ws(" ", nonempty("_plain"), nonempty("_more"))
    out = texts.select(
        "seq",
        strip_text(_f("text")).alias("title"),
        F.lit(None).cast("string").alias("company"),
        F.coalesce(_f("categories.location"), F.lit("")).alias("location"),
        first_truthy(_f("hostedUrl"), _f("applyUrl")).alias("url"),
        "source_name",
        F.lit("lever").alias("source_type"),
        desc.alias("description"),
        salary_text(_f("salaryRange.min"), _f("salaryRange.max"), _f("salaryRange.currency")).alias("salary"),
        F.coalesce(_f("categories.commitment"), F.lit("")).alias("employment_type"),
        F.coalesce(_f("createdAt"), F.lit("")).alias("date_posted"),
        F.col("raw").alias("raw_data"),
    )
    return out.filter(F.col("title") != "")


def read_lever(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """Lever boards: each payload is a top-level JSON array of postings."""
    return lever_rows(items(payload_lines(spark, root, multi_line), "lever"))


def read_ashby(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """Ashby boards: ``{"jobs": [...]}``; location is text or ``{"name": ...}``."""
    rows = _readable(items(payload_lines(spark, root, multi_line), "ashby"), "ashby")
    comp = F.try_variant_get("item", "$.compensation", "variant")
    out = rows.select(
        "seq",
        strip_text(_f("title")).alias("title"),
        F.lit(None).cast("string").alias("company"),
        F.coalesce(_f("location.name"), _text("location"), F.lit("")).alias("location"),
        first_truthy(_f("jobUrl"), _f("applyUrl")).alias("url"),
        "source_name",
        F.lit("ashby").alias("source_type"),
        html_to_text(first_truthy(_f("descriptionHtml"), _f("description"))).alias("description"),
        F.coalesce(F.try_variant_get("item", "$.compensation", "string"), F.to_json(comp), F.lit("")).alias("salary"),
        F.coalesce(_f("employmentType"), F.lit("")).alias("employment_type"),
        F.coalesce(_f("publishedAt"), F.lit("")).alias("date_posted"),
        F.col("raw").alias("raw_data"),
    )
    return out.filter(F.col("title") != "")


def read_greenhouse(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """Greenhouse boards: location name, else the office names joined by ', '."""
    rows = _readable(items(payload_lines(spark, root, multi_line), "greenhouse"), "greenhouse")
    offices = F.coalesce(F.try_variant_get("item", "$.offices", "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(offices, lambda o: F.coalesce(F.try_variant_get(o, "$.name", "string"), F.lit("")))
    out = rows.select(
        "seq",
        strip_text(_f("title")).alias("title"),
        F.lit(None).cast("string").alias("company"),
        first_truthy(_f("location.name"), F.array_join(F.filter(names, lambda n: n != ""), ", ")).alias("location"),
        F.coalesce(_f("absolute_url"), F.lit("")).alias("url"),
        "source_name",
        F.lit("greenhouse").alias("source_type"),
        html_to_text(_f("content")).alias("description"),
        F.lit("").alias("salary"),
        F.lit("").alias("employment_type"),
        F.coalesce(_f("updated_at"), F.lit("")).alias("date_posted"),
        F.col("raw").alias("raw_data"),
    )
    return out.filter(F.col("title") != "")


def faulty_items(rows: DataFrame, kind: str) -> DataFrame:
    """Postings of ``items`` that can't be read, with the fields that are at fault."""
    what = F.concat(F.col("source_name"), F.lit(f": CollectorError: Unexpected {kind} posting: "), F.array_join("faults", ", "))
    return rows.filter(F.size("faults") > 0).select("source_name", F.lit(kind).alias("source_type"), what.alias("error"))


def quarantine(spark: SparkSession, root: str, kind: str, multi_line: bool = False) -> DataFrame:
    """Payloads that are not of the expected shape, and single postings with a field that is not."""
    lines = payload_lines(spark, root, multi_line)
    return quarantine_lines(lines, None if kind == "html" else items(lines, kind), kind)


def quarantine_lines(lines: DataFrame, rows: DataFrame | None, kind: str) -> DataFrame:
    """Payloads of ``lines`` that are not of the expected shape and faulty postings of ``rows`` (those of ``items``)."""
    payloads = lines.filter(~F.coalesce(_well_shaped(kind), F.lit(False))).select(
        "source_name",
        F.lit(kind).alias("source_type"),
        F.concat(F.col("source_name"), F.lit(": CollectorError: Unexpected "), F.lit(kind), F.lit(" API response")).alias("error"),
    )
    return payloads if rows is None else payloads.unionByName(faulty_items(rows, kind))


_ANCHOR = r"(?s)^<(?i:a)[ \t\n\r\f/>]"
_ANCHOR_END = r"(?s)^</[ \t\n\r\f]*(?i:a)[ \t\n\r\f/>]"
ANCHOR_ATTRIBUTES = ("href", "title", "aria-label")


def page_links(pages: DataFrame, keep: tuple[str, ...] = (), number: str | None = None) -> DataFrame:
    """Every anchor of every page: (page_id, pos, href, text, title_attr, aria_label) and the columns ``keep``.

    ``number`` names a column that orders the anchors by page (by its ``place``, where pages have and keep one) and position.

    Anchors are tokens of the page, so what looks like one within a comment, a script or a quoted value isn't.
    An anchor ends at its end tag, or at the next anchor when it has none.
    """
    page = pages.select("page_id", F.col("url").alias("page_url"), *keep, tokens("html").alias("tokens"))
    # places (from 1) of the tokens that begin or end an anchor, then each beginning with the next place
    places = F.filter(F.transform("tokens", lambda t, i: F.when(t.rlike(_ANCHOR) | t.rlike(_ANCHOR_END), i + 1)), lambda i: i.isNotNull())
    page = page.select("page_id", "page_url", *keep, "tokens", places.alias("places"))
    ends = F.concat(F.slice("places", 2, 1 << 30), F.array(F.size("tokens") + 1))
    spans = F.zip_with("places", ends, lambda b, e: F.struct(F.get("tokens", b - 1).alias("tag"), F.slice("tokens", b + 1, e - b - 1).alias("inner")))
    z = page.select("page_id", "page_url", *keep, F.posexplode(F.filter(spans, lambda x: x["tag"].rlike(_ANCHOR))).alias("pos", "x"))
    spaced = F.array_join(F.transform(F.col("x.inner"), lambda t: F.when(is_markup(t), F.lit(" ")).otherwise(t)), "")
    texts = F.filter(F.col("x.inner"), lambda t: ~is_markup(t))
    z = z.select(
        "page_id",
        "page_url",
        *keep,
        *([_seq(pages).alias(number)] if number else []),
        (F.col("pos") + 1).cast("long").alias("pos"),
        F.array_join(texts, "").alias("raw_text"),  # '' only when the anchor has no text at all
        decode_each(F.concat(attributes(F.col("x.tag"), ANCHOR_ATTRIBUTES), F.array(spaced))).alias("v"),
    )
    return z.select(
        "page_id",
        "page_url",
        *keep,
        *([number] if number else []),
        "pos",
        F.get("v", F.lit(0)).alias("href"),
        clean_text(F.get("v", F.lit(3))).alias("text"),
        "raw_text",
        F.get("v", F.lit(1)).alias("title_attr"),
        F.get("v", F.lit(2)).alias("aria_label"),
    )


def html_links(pages: DataFrame, keep: tuple[str, ...] = (), number: str | None = None) -> DataFrame:
    """Job links of HTML pages: anchors with an href, resolved against the page
    URL; title = anchor text, else title attribute, else aria-label; the first
    titled anchor per absolute URL and page wins.  ``keep`` and ``number`` as in ``page_links``."""
    from pyspark.sql import Window

    links = page_links(pages, keep, number).filter(F.col("href").isNotNull() & (F.col("href") != ""))
    # attributes are used only when the anchor has no text at all (whitespace-only text counts as text)
    title = F.when(F.col("raw_text") != "", F.col("text")).otherwise(
        clean_text(first_truthy(F.col("title_attr"), F.col("aria_label")))
    )
    out = links.select(
        "page_id", "pos", resolve_url("page_url", "href").alias("url"), title.alias("title"), *keep, *([number] if number else [])
    ).filter(F.col("title") != "")
    w = Window.partitionBy("page_id", "url").orderBy("pos")
    return out.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def read_html(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """HTML sources: each payload is a landed page ``{"url": ..., "html": ...}``; its titled links are the postings."""
    lines = payload_lines(spark, root, multi_line).filter(F.coalesce(_well_shaped("html"), F.lit(False)))
    page = F.from_json("value", "struct<url: string, html: string>")
    pages = lines.select("source_name", "place", F.monotonically_increasing_id().alias("page_id"), page.alias("p"))
    pages = pages.select("source_name", "place", "page_id", "p.url", F.col("p.url").alias("source_page"), "p.html")
    links = html_links(pages, keep=("source_name", "source_page", "place"), number="seq")
    empty = F.lit("")
    return links.select(
        "seq",
        "title",
        F.lit(None).cast("string").alias("company"),
        empty.alias("location"),
        "url",
        "source_name",
        F.lit("html").alias("source_type"),
        empty.alias("description"),
        empty.alias("salary"),
        empty.alias("employment_type"),
        empty.alias("date_posted"),
        F.to_json(F.struct("source_page")).alias("raw_data"),
    )


READERS = {
    "ashby": read_ashby,
    "greenhouse": read_greenhouse,
    "html": read_html,
    "lever": read_lever,
}


def union_sources(frames: list[DataFrame], sources: DataFrame) -> DataFrame:
    """Reader outputs (one frame per source type) unioned by column name and
    limited to enabled sources by a semi-join on the (small) source dimension."""
    u = reduce(DataFrame.unionByName, frames)
    enabled = sources.filter(F.coalesce(F.col("enabled"), F.lit(False))).select(F.col("name").alias("source_name"))
    return u.join(broadcast_if_small(enabled), "source_name", "left_semi")


def with_company(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Company = configured company, else the source name (absent key, not empty)."""
    dims = sources.select(F.col("name").alias("source_name"), F.col("company").alias("_company"))
    j = raw.join(broadcast_if_small(dims), "source_name", "left")
    return j.withColumn("company", F.coalesce(F.col("_company"), F.col("source_name"), F.lit(""))).drop("_company")


FEED_JOB = T.StructType([T.StructField(c, T.IntegerType() if c == "match_score" else S) for c in (
    "job_hash", "title", "company", "location", "url", "source_name", "source_type", "salary", "employment_type",
    "date_posted", "date_found", "last_seen", "status", "match_score", "match_reason",
)])
FEED_MANIFEST = T.StructType(
    [T.StructField("generated_at", S), T.StructField("minimum_score", T.IntegerType()), T.StructField("total", T.LongType())]
)


def read_feed(spark: SparkSession, root: str) -> DataFrame:
    """Public feed as written by the export: ``jobs/`` (JSON Lines) + ``manifest/``, in the folder
    that ``CURRENT`` names where the feed is published in versions.

    Each job row carries the manifest's generated_at and minimum_score (the
    manifest is one row, read as two scalars).
    """
    from ..operators.snapshots import POINTER, read_pointer

    live = read_pointer(f"{root.rstrip('/')}/{POINTER}", spark)
    root = f"{root.rstrip('/')}/{live}" if live else root
    jobs = spark.read.schema(FEED_JOB).json(f"{root}/jobs")
    m = spark.read.schema(FEED_MANIFEST).json(f"{root}/manifest").first()
    gen, minimum = (m.generated_at, m.minimum_score) if m else (None, None)
    return jobs.withColumn("generated_at", F.lit(gen).cast("string")).withColumn(
        "minimum_score", F.lit(minimum).cast("int")
    )


def read_feed_envelope(spark: SparkSession, path: str) -> DataFrame:
    """A single-document envelope ``{generated_at, minimum_score, total, jobs[]}``; missing jobs -> no rows."""
    schema = T.StructType(FEED_MANIFEST.fields + [T.StructField("jobs", T.ArrayType(FEED_JOB))])
    env = spark.read.schema(schema).option("multiLine", True).json(path)
    return env.select("generated_at", "minimum_score", F.explode_outer(F.coalesce(F.col("jobs"), F.array())).alias("j")).filter(
        F.col("j").isNotNull()
    ).select("generated_at", "minimum_score", "j.*")


# header of the review sheet -> edit column (fixed values: the sheet's column titles)
EDIT_HEADERS = (("Status", "status"), ("Notes", "notes"), ("Job Hash", "job_hash"), ("URL", "url"), ("Row", "seq"))


def read_edits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edited review sheet (CSV with a header) -> ``(seq, job_hash, url, status, notes)``.

    Columns are found by their (trimmed) header; absent ones become NULL.
    ``seq`` is the sheet's ``Row`` column when present (later rows win).
    """
    df = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False).csv(path)
    by_header = {c.strip(): c for c in df.columns}

    def col(header: str, name: str):
        src = by_header.get(header)
        return (F.col(f"`{src}`") if src else F.lit(None)).cast("string").alias(name)

    seq = F.col(f"`{by_header['Row']}`").cast("long") if "Row" in by_header else F.monotonically_increasing_id()
    return df.select(
        seq.alias("seq"),
        *[col(h, n) for h, n in EDIT_HEADERS if n != "seq"],
    ).select(
        "seq",
        F.when(F.col("job_hash") != "", F.col("job_hash")).alias("job_hash"),
        F.when(F.col("url") != "", F.col("url")).alias("url"),
        "status",
        "notes",
    )
