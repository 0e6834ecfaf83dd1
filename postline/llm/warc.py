"""WARC archives: records of pages, written, read back, and assembled into captures.

Writing. Each page gives three records, request, response and metadata, tied by
WARC-Concurrent-To identifiers. A payload of at least ``least`` bytes that a page of larger
id has as well becomes a revisit record without it, whose WARC-Refers-To names the response's record. The archives are gzip files in a shared
folder, written by Spark's text writer (a record of UTF-8 pages is text whose last byte is the
line end).

Reading. Spark's text reader cuts the archives where a version line (WARC/1.0 or 1.1) may begin. A payload may hold
such a text itself, so Content-Length decides: pieces are joined until a record is whole, and anything but line
ends behind a record is an error, as is an archive that ends within one. Archives
are compressed, so a file is one stream and a record never lies in two tasks; memory is bounded by
the longest record.

Assembly. Requests and metadata belong to the response or revisit record that they are
concurrent to: directly, the other way round, or through one record between them. The result is
one nested row for each capture; records that lead to no response form a capture of their own
with a null response.

Defined cases: a null html is an empty payload (0 bytes, a response); null urls and ids leave
their fields out and come back null; a page with a null id is never the response that others
refer to unless all with its payload have null ids; equal rows give captures of their own, those
with the largest id all being responses; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.llm.common import cut, shared_folder, ship

VERSION = "WARC/1.1"
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _urn(h: Column) -> Column:
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def record_id(kind: str) -> Column:
    """A record id that is unique to the row and kind."""
    return _urn(F.md5(F.concat_ws(":", F.lit(kind), F.col("row").cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))))


def record(kind: Column, own_id: Column, fields: list[tuple[str, Column]], content: Column) -> Column:
    """A record as text; a field whose value is null is left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", F.lit(DATE)), *fields, ("Content-Length", F.octet_length(content).cast("string"))]
    lines = F.concat_ws(CRLF, F.lit(VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in head])
    return F.concat(lines, F.lit(CRLF * 2), content, F.lit(CRLF * 2))


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> None:
    """Three records for each row of pages, as gzip archives in folder."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    # narrow: only payloads that several pages have; what goes with the pages is a row for each such payload
    shared = own.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.max_by("n", "page_id").alias("n_first"), F.sum("n").alias("n")).where("n > 1")
    # the one record that others refer to has an id that all of them can tell
    told = F.when(F.col("n_first") == 1, _urn(F.md5(F.concat_ws(":", F.lit("first"), F.col("first_id").cast("string"), F.col("digest")))))
    shared = cut(shared.select(F.col("digest").alias("_digest"), "first_id", told.alias("first_record")), "shared")
    rows = own.join(shared, own.digest == F.col("_digest"), "left").withColumn("row", F.monotonically_increasing_id())
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    own_id = F.when((F.col("page_id") == F.col("first_id")) & F.col("first_record").isNotNull(), F.col("first_record")).otherwise(record_id("response"))
    rows = rows.withColumn("response", own_id)
    response, request, target = F.col("response"), record_id("request"), ("WARC-Target-URI", url)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    main = record(
        F.when(revisit, "revisit").otherwise("response"), response,
        [target, digest, ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, F.col("first_record"))), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    ask = record(F.lit("request"), request, [target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"via: pages{CRLF}"))
    more = record(F.lit("metadata"), record_id("metadata"), [target, ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields"))], about)
    text = F.concat(ask, main, more)
    # the writer adds the last line end
    rows.select(F.substring(text, F.lit(1), F.length(text) - 1).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(folder)


LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
RECORD = "type string, record_id string, concurrent_to array<string>, target_uri string, date string, fields map<string, string>, http_length long, payload_bytes long, payload_sha1 string"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse(raw: bytes, with_content: bool) -> tuple:
    """A whole record (what follows its version line) as a row of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    told = dict(fields)
    content = rest[: int(told["content-length"])]
    payload, http_length = content, None
    if told.get("content-type", "").startswith("application/http"):
        http, _, payload = content.partition(b"\r\n\r\n")
        length = dict(_fields(http.partition(b"\r\n")[2])).get("content-length")
        http_length = int(length) if length and length.isdigit() else None
    concurrent = [v for k, v in fields if k == "warc-concurrent-to"]
    row = (told.get("warc-type"), told.get("warc-record-id"), concurrent, told.get("warc-target-uri"), told.get("warc-date"), list(told.items()), http_length, len(payload), hashlib.sha1(payload).hexdigest())
    return (*row, payload) if with_content else (*row, payload if told.get("warc-type") == "metadata" else None)


#: What every version line begins with, and what follows it there.
MARK, VERSIONS = "WARC/1.", (b"0\r\n", b"1\r\n")


def whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    """Records (without their version line) from (file, piece) in order, pieces being what lies between marks."""
    mark = MARK.encode()
    held, name, need = bytearray(), None, 0

    def wanted(raw: bytes | bytearray) -> int:
        at = raw.find(b"\r\n\r\n")
        if at < 0:
            return len(raw) + 1
        length = LENGTH.search(raw, 0, at)
        if length is None:
            raise ValueError("a WARC record has no Content-Length")
        return at + 4 + int(length[1])

    def done() -> bytes:
        if len(held) < need:
            raise ValueError(f"{name} ends within a record")
        if held[need:].strip(b"\r\n"):
            raise ValueError(f"{name} has bytes between records")
        return bytes(held[3:need])

    for file, piece in pieces:
        if held and file == name and len(held) < need:
            held += mark + piece  # that mark was part of a record
        else:
            if held:
                yield done()
            if piece[:3] not in VERSIONS and piece.strip(b"\r\n"):
                raise ValueError(f"{file} has bytes between records")
            held, name = bytearray(piece if piece[:3] in VERSIONS else b""), file
        need = wanted(held) if held else 0
    if held:
        yield done()


def read_records(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """RECORD and ``content`` (binary; without ``with_content`` that of metadata records only) of each record in the gzip archives of folder."""
    ship(spark)
    lines = spark.read.option("lineSep", MARK).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for file, value in zip(batch.column(0), batch.column(1), strict=True):
                    yield file.as_py(), value.as_py()

        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows, size = [], 0
        for raw in whole_records(pieces()):
            rows.append(parse(raw, with_content))
            size += len(raw)
            if len(rows) >= 5000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f"c{i}" for i in range(10)])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f"c{i}" for i in range(10)])

    return lines.mapInArrow(run, RECORD + ", content binary")


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, response (struct; null for orphans), requests and metadata (arrays of structs).

    ``records`` has RECORD and content. Only identifiers are joined to find a record's
    capture; the records themselves are shuffled once, by capture.
    """
    body = F.struct(*records.columns)
    main = F.col("type").isin("response", "revisit", "resource")
    ids = records.select("record_id", F.explode_outer("concurrent_to").alias("peer"), main.alias("main"))
    mains = ids.where("main").select(F.col("record_id").alias("capture")).distinct()
    others = ids.where("not main").select("record_id", "peer")
    # (record, record it is concurrent to), both ways where a response names the others
    named = ids.where("main and peer is not null").select(F.col("peer").alias("record_id"), F.col("record_id").alias("peer"))
    pairs = others.where("peer is not null").unionByName(named)
    direct = pairs.join(mains, pairs.peer == mains.capture).select("record_id", "capture")
    between = direct.select(F.col("record_id").alias("via"), F.col("capture").alias("to"))
    further = pairs.join(between, pairs.peer == between.via).select("record_id", F.col("to").alias("capture"))
    ranked = direct.withColumn("hops", F.lit(1)).unionByName(further.withColumn("hops", F.lit(2)))
    where = ranked.groupBy("record_id").agg(F.min(F.struct("hops", "capture")).getField("capture").alias("capture"))
    rest = records.where(~main).select(F.col("record_id").alias("_id"), F.col("type").alias("_type"), body.alias("body"))
    rest = rest.join(where, rest["_id"] == where["record_id"], "left").select(F.coalesce("capture", "_id").alias("capture_id"), "_type", "body")
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.struct(F.col("body.record_id").alias("at"), F.col("body").alias("body")))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    grouped = rest.groupBy("capture_id").agg(of(F.col("_type") == "request").alias("requests"), of(F.col("_type") != "request").alias("metadata"))
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.expr(f"slice({c}, 1, 0)")), lambda x: x["body"])
    grouped = grouped.select("capture_id", plain("requests").alias("requests"), plain("metadata").alias("metadata"))
    responses = records.where(main).select(F.col("record_id").alias("_main"), body.alias("response"))
    return responses.join(grouped, F.col("_main") == F.col("capture_id"), "full").select(F.coalesce("_main", "capture_id").alias("capture_id"), "response", "requests", "metadata")


def captures_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, method of every row of pages, from archives written and read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_pages(pages, folder, id_col, url_col, html_col, least)
    nested = assemble(cut(read_records(spark, folder, with_content=False), "records"))
    about = F.decode(F.element_at("metadata.content", 1), "UTF-8")
    revisit = F.col("response.type") == "revisit"
    rows = nested.where("response is not null").select(
        "capture_id",
        F.regexp_extract(about, r"(?m)^page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.when(revisit, F.col("response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(F.element_at("response.fields", "warc-payload-digest"), "^sha1:", "")).otherwise(F.col("response.payload_sha1")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.target_uri").alias("url"), F.size("requests").alias("n_requests"),
        F.when(revisit, F.try_element_at("response.fields", F.lit("warc-refers-to"))).alias("refers"),
    )
    rows = cut(rows, "captures")
    whole, visits = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    named = whole.select(F.col("capture_id").alias("_record"), F.col("page_id").alias("refers_to"))
    by_record = visits.where("refers is not null").join(named, F.col("refers") == F.col("_record"), "left").drop("_record")
    first = whole.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least)).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"))
    by_digest = visits.where("refers is null").join(first.withColumnRenamed("payload_digest", "_digest"), F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")
    rows = whole.withColumn("refers_to", F.lit(None).cast("long")).unionByName(by_record).unionByName(by_digest)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "n_requests")
