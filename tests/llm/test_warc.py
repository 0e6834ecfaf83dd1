import gzip
import hashlib

import pytest

from postline.llm import warc
from tests.llm.helpers import collected

SCHEMA = "page_id long, url string, html string, row string, digest string, size string, first_id string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def plain(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = max(ids, default=None)
        visit = len(raw) >= 1000 and page_id != first
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", first if visit else None))
    return sorted(out, key=repr)


def test_pages_round_trip(spark):
    big = "<html>é🎉 " + "x" * 1000
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 20
    rows = [
        (1, "http://a/", big), (2, "http://b/ x\r\ny", big), (7, None, big), (3, "http://c/", "small"), (4, "http://c/", "small"), (5, "http://d/", None),
        (6, "http://e/", ""), (8, "http://f/", tricky), (9, "http://g/", tricky), (10, "u", "WARC/1.1\r\n"), (None, "http://h/", big), (None, None, None),
        (11, "v", "y" * 300_000), (12, "v", "\n\r\n"), (13, "w", "z" * 2000), (13, "w", "z" * 2000), (12, "v", "z" * 2000),
    ]
    out = warc.captures_of_pages(frame(spark, rows))
    assert collected(out, *COLUMNS) == plain(rows)
    assert all(r.n_requests == 1 for r in out.collect())
    assert warc.captures_of_pages(frame(spark, [])).collect() == []


def one(kind, own, concurrent=(), content=b"x", more=()):
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), *(("WARC-Concurrent-To", c) for c in concurrent), *more, ("Content-Length", str(len(content)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + content + b"\r\n\r\n"


def test_transactions_are_assembled_by_every_way_of_concurrence(spark, tmp_dir):
    records = [
        one("warcinfo", "i"), one("response", "r1", content=b"\xff\xfe raw"), one("request", "q1", ["r1"]), one("metadata", "m1", ["q1"]), one("metadata", "m0", ["r1", "q1"]),
        one("response", "r2", ["q2", "m2"]), one("request", "q2"), one("metadata", "m2"), one("request", "lost", ["none"]), one("revisit", "r3"),
    ]
    with open(f"{tmp_dir}/a.warc.gz", "wb") as f:  # a member for each record, as archives usually have
        f.write(b"".join(gzip.compress(r) for r in records))
    read = warc.read_records(spark, f"file://{tmp_dir}/a.warc.gz")
    assert read.count() == 10 and bytes(read.where("record_id = 'r1'").first().content) == b"\xff\xfe raw"
    got = {r.capture_id: (r.response and r.response.record_id, [x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []]) for r in warc.assemble(read).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m0", "m1"]), "r2": ("r2", ["q2"], ["m2"]), "r3": ("r3", [], []), "lost": (None, ["lost"], []), "i": (None, [], ["i"])}


def test_a_cut_archive_is_an_error(spark, tmp_dir):
    with open(f"{tmp_dir}/b.warc.gz", "wb") as f:
        f.write(gzip.compress(one("response", "r1", content=b"y" * 100)[:-60]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_records(spark, f"file://{tmp_dir}/b.warc.gz").count()


def test_pieces_are_joined_until_a_record_is_whole():
    line, mark = b"WARC/1.1\r\n", b"WARC/1."
    inner = b"p" + line + b"q" + line + b"WARC/1.0 and WARC/1."
    raw = one("response", "a", content=inner) + one("response", "b", content=b"")
    pieces = [("f", x) for x in raw.split(mark)] + [("g", x) for x in one("request", "c").split(mark)]
    assert [warc.parse(r, True)[1] for r in warc.whole_records(iter(pieces))] == ["a", "b", "c"]
    assert warc.parse(next(warc.whole_records(iter(pieces))), True)[-1] == inner


def test_both_versions_are_read_and_nothing_is_dropped(spark, tmp_dir):
    old = lambda *a, **k: one(*a, **k).replace(b"WARC/1.1", b"WARC/1.0", 1)
    for name, records in {"old": [old("response", "a"), old("request", "b", ["a"]), old("metadata", "c", ["b"])], "mixed": [one("response", "a"), old("response", "b"), one("response", "c")]}.items():
        with open(f"{tmp_dir}/{name}.warc.gz", "wb") as f:
            f.write(gzip.compress(b"".join(records)))
        assert [r.record_id for r in warc.read_records(spark, f"file://{tmp_dir}/{name}.warc.gz").collect()] == ["a", "b", "c"]
    for i, junk in enumerate((one("response", "a") + b"lost bytes", b"ahead" + one("response", "a"), one("response", "a", content=b"xyz").replace(b"Content-Length: 3", b"Content-Length: 1"), one("response", "a") + b"WARC/0.9\r\n" + one("response", "b"))):
        with open(f"{tmp_dir}/j{i}.warc.gz", "wb") as f:
            f.write(gzip.compress(junk))
        with pytest.raises(Exception, match="bytes between records"):
            warc.read_records(spark, f"file://{tmp_dir}/j{i}.warc.gz").count()


def test_revisits_name_the_record_they_refer_to(spark, tmp_dir):
    folder = f"file://{tmp_dir}/w"
    warc.write_pages(frame(spark, [(1, "a", "q" * 2000), (5, "b", "q" * 2000), (3, "c", "q" * 2000), (2, "d", "r" * 1500), (2, "d", "r" * 1500), (1, "e", "r" * 1500)]), folder)
    read = warc.read_records(spark, folder).collect()
    main = {r.record_id: r for r in read if r.type in ("response", "revisit")}
    assert len(main) == 6 and len({r.record_id for r in read}) == 18
    for r in main.values():
        to = r.fields.get("warc-refers-to")
        if r.type == "revisit" and r.target_uri in "abc":
            assert main[to].target_uri == "b" and main[to].type == "response" and main[to].fields["warc-payload-digest"] == r.fields["warc-payload-digest"]
        else:
            assert to is None
