from datetime import datetime, timezone

import pytest

from postline.functions.dates import normalize_date

dateutil = pytest.importorskip("dateutil.parser")


def _expected(value):
    # the stated behaviour: digits are epoch seconds (ms above 1e10) in local time, else a parsed date
    if value in (None, ""):
        return ""
    if str(value).isdigit():
        n = float(value)
        if n > 10_000_000_000:
            n /= 1000
        return datetime.fromtimestamp(n, timezone.utc).isoformat(timespec="seconds")
    try:
        return dateutil.parse(str(value)).isoformat()
    except (ValueError, OverflowError):
        return str(value)


def test_normalize_date_matches_reference_on_supported_forms(spark):
    values = [
        "2024-03-05T10:20:30Z", "2024-03-05T10:20:30-04:00", "2024-03-05 10:20:30", "2024-03-05",
        "2024-03-05T10:20:30.250+0530", "2024-03-05T10:20:30+02:00", "1700000000", "1700000000123", "20240102",
        "0", "", None, "Mar 5, 2024", "2024-03-05T23:59:59.000001",
    ]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = {r.d: r.n for r in df.select("d", normalize_date("d").alias("n")).collect()}
    for v in values:
        assert got[v] == _expected(v), v


def test_unparsable_text_is_kept(spark):
    df = spark.createDataFrame([("soon",), ("next week-ish",)], "d string")
    assert [r.n for r in df.select(normalize_date("d").alias("n")).collect()] == ["soon", "next week-ish"]


def test_more_layouts(spark):
    texts = {"Mar 5 2024": "2024-03-05T00:00:00", "5 March 2024": "2024-03-05T00:00:00", "3/5/2024": "2024-03-05T00:00:00",
             "March 5, 2024 10:30 AM": "2024-03-05T10:30:00", "Tue, 05 Mar 2024 10:20:30 GMT": "2024-03-05T10:20:30+00:00",
             "Tue, 5 Blah 2024": "Tue, 5 Blah 2024", "8 June 2026 10:00": "2026-06-08T10:00:00", "2026-06-08 10:30 AM": "2026-06-08T10:30:00",
             "3.5.2026": "2026-03-05T00:00:00", "6/8/26": "2026-06-08T00:00:00", "Monday, June 8, 2026": "2026-06-08T00:00:00"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", normalize_date("t").alias("n")).collect()} == texts


def test_every_layout_reads_as_the_date_guesser_does(spark):
    days = ["June 8, 2026", "Jun 8, 2026", "Jun. 8 2026", "8 June 2026", "08 Jun 2026", "8-Jun-2026", "2026-6-8", "2026/06/08", "2026.06.08", "6/8/2026", "06-08-2026", "6.8.2026", "6/8/26", "6-8-26", "Sept 8, 2026", "September 8 2026", "Mon, Jun 8, 2026", "Monday 8 June 2026", "8 may 2026", "DEC 31, 1999", "Tue, 9 June 2026", "2026 Jun 8"]
    clocks = ["", " 10:30", " 10:30:05", " 1:05 PM", " 01:05:07 am", " 12:00 AM", " 9:15pm", ", 7:45 PM", " at 16:20"]
    texts = [d + c for d in days for c in clocks]
    texts += ["June 31, 2026", "13/45/2026", "June 8", "8 June 2026 25:00", "8 June 2026 10:00 PST", "Tuesday", "2026-06-08 10:30 XM", "1.2", "June 8, 2026 soon", "Tue, 05 Mar 2024 10:20:30 UTC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.select("t", normalize_date("t").alias("n")).collect()}
    assert {t: got[t] for t in texts[:-10] if got[t] != _expected(t)} == {}
    assert [got[t] for t in texts[-10:-1]] == texts[-10:-1] and got[texts[-1]] == "2024-03-05T10:20:30+00:00"
