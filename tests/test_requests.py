import random
from urllib.parse import urlsplit

from postline.operators import requests_log as R


def _log(spark, rows):
    return spark.createDataFrame(rows, "seq long, url string, api boolean, status_code int, ts timestamp")


def _fold(rows, total, lim, lim_api):
    """Sequential rate limiter, one request at a time."""
    n, per, out = 0, {}, {}
    for seq, url, api, *_ in sorted(rows):
        d = urlsplit(url).netloc.casefold()
        limit = lim_api if api else lim
        if n >= total:
            out[seq] = "total"
        elif per.get(d, 0) >= limit:
            out[seq] = "domain"
        else:
            n += 1
            per[d] = per.get(d, 0) + 1
            out[seq] = "granted"
    return out


def test_enforces_per_domain_limit(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    log = _log(spark, [(1, "https://example.com/one", False, 200, t), (2, "https://example.com/two", False, 200, t)])
    got = {r.seq: r.decision for r in R.request_admission(log, max_total=10, per_domain=1, per_api_domain=1).collect()}
    assert got == {1: "granted", 2: "domain"}


def test_admission_equals_sequential_fold(spark):
    import datetime as dt

    rnd = random.Random(5)
    t = dt.datetime(2026, 1, 1)
    for trial in range(6):
        rows = [(i, f"https://{rnd.choice('abc')}.example.com/{i}", rnd.random() < 0.5, 200, t)
                for i in rnd.sample(range(1, 500), 60)]
        total, lim, lim_api = rnd.choice([(15, 2, 5), (100, 3, 7), (30, 1, 1)])
        want = _fold(rows, total, lim, lim_api)
        got = {r.seq: r.decision for r in R.request_admission(_log(spark, rows), total, lim, lim_api, salts=4).collect()}
        assert got == want, trial


def test_backoff_ladder_and_pacing(spark):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, "https://a.com/x", i % 2 == 0, 429, t0 + dt.timedelta(seconds=2 * i)) for i in range(1, 7)]
    rows.append((7, "https://b.com/x", False, 200, t0))
    log = _log(spark, rows)
    got = {r.seq: (r.attempt, r.delay_seconds) for r in R.backoff_delays(log, salts=2).collect()}
    assert got == {1: (1, 60), 2: (2, 120), 3: (3, 300), 4: (4, 600), 5: (4, 600), 6: (4, 600)}
    pace = {r.seq: (r.gap_seconds, r.shortfall_seconds) for r in R.pacing_shortfall(log).collect()}
    assert pace[1] == (None, 0.0) and pace[7] == (None, 0.0)
    assert pace[2] == (2.0, 1.0)  # api call: 3 s minimum
    assert pace[3] == (2.0, 18.0)  # page call: 20 s minimum


def test_response_classes(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    log = _log(spark, [(1, "u", False, 403, t), (2, "u", False, 429, t), (3, "u", False, 500, t), (4, "u", False, 302, t)])
    got = {r.seq: r.response_class for r in R.response_classes(log).collect()}
    assert got == {1: "skipped", 2: "backed_off", 3: "error", 4: "ok"}


def test_hot_domain_lag_spans_partitions(spark):
    import datetime as dt

    from postline.operators.ordering import ordered_lag

    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, "hot", t0 + dt.timedelta(seconds=i)) for i in range(200)] + [(1000 + i, f"d{i}", t0) for i in range(5)]
    df = spark.createDataFrame(rows, "seq long, domain string, ts timestamp")
    got = {r.seq: r.prev for r in ordered_lag(df, "domain", ["ts", "seq"], "seq", "prev", partitions=7).collect()}
    assert got[0] is None and all(got[i] == i - 1 for i in range(1, 200))
    assert all(got[1000 + i] is None for i in range(5))
