"""Hot keys: one key holds a third of all rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from postline.operators import merge
from postline.operators import requests_log as R
from postline.operators.ordering import salted_top_k
from tests.conftest import frame


def test_salted_top_k_with_hot_key(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rnd.randint(0, 50)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, key string").repartition(8)
    got = salted_top_k(df, "key", ["seq"], 5, salts=16).collect()
    want = {}
    for seq, key in sorted(rows):
        want.setdefault(key, [])
        if len(want[key]) < 5:
            want[key].append(seq)
    assert sorted((r.key, r.seq, r.rn) for r in got) == sorted(
        (k, s, i + 1) for k, v in want.items() for i, s in enumerate(v)
    )


def test_admission_with_hot_domain(spark):
    from tests.test_requests import _fold

    rnd = random.Random(2)
    t = dt.datetime(2026, 1, 1)
    rows = [(i, "https://hot.example/x" if i % 3 == 0 else f"https://d{rnd.randint(0, 40)}.example/x", rnd.random() < 0.5, 200, t)
            for i in range(1, 3001)]
    log = spark.createDataFrame(rows, "seq long, url string, api boolean, status_code int, ts timestamp").repartition(8)
    got = {r.seq: r.decision for r in R.request_admission(log, 300, 10, 50, salts=16).collect()}
    assert got == _fold(rows, 300, 10, 50)


def test_collapse_with_hot_entity_aggregates_before_the_shuffle(spark):
    rows = [dict(seq=i, title="Graphics Engineer" if i % 3 == 0 else f"Role {i}", company="Acme",
                 location="Austin", url="https://hot.example/1" if i % 3 == 0 else f"https://x/{i}")
            for i in range(1, 1201)]
    df = frame(spark, rows).repartition(8)
    n = merge.normalize_postings(df).withColumn("match_score", F.lit(1)).withColumn("match_reason", F.lit(""))
    out = merge.collapse_batch(n)
    hot = out.filter(F.col("entity_key") == "https://hot.example/1").first()
    assert (hot.sightings, hot.first_seq, hot.last_seq) == (400, 3, 1200)
    assert out.count() == 801
    plan = out._jdf.queryExecution().executedPlan().toString()
    # partial aggregation below the exchange: a hot key is one row per map task before the shuffle
    assert plan.count("SortAggregate") + plan.count("HashAggregate") >= 2
    assert "partial_min_by" in plan or "partial_max_by" in plan
    assert "WindowGroupLimit" in plan and "Partial" in plan
