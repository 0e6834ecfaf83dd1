import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, key, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["ranked_postings", "normalize_url", "upsert_postings", "apply_edits", "request_admission",
          "review_buckets", "status_counts", "html_links", "scan_greenhouse"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["rank", "job_hash", "title"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    perm = [ocols.index(c) for c in df.columns]
    want = sorted((tuple(norm(r[i]) for i in perm) for r in cur.fetchall()), key=key)
    got = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=key)
    assert got == want


MAIN_PATH = ["ranked_postings", "normalized_postings", "relevance_score", "upsert_postings", "apply_edits",
             "public_feed", "eligibility_purge", "html_links", "request_admission", "keyword_hits"]


@pytest.mark.parametrize("name", MAIN_PATH)
def test_no_python_udf_on_main_path(spark, name):
    from postline.plans import queries as Q
    from postline.operators import merge

    df = entry.queries()[name](spark, SF)
    plans = [df._jdf.queryExecution().executedPlan().toString()]
    # the written tables these queries read are built by the same operators
    plans.append(merge.flag_batch(Q.fx.postings(spark, SF), Q.RULES)._jdf.queryExecution().executedPlan().toString())
    for p in plans:
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in p, (name, node)


def test_score_threshold_is_pushed_to_the_scan(spark):
    df = entry.queries()["score_threshold"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(match_score), GreaterThanOrEqual(match_score,35)]" in plan


def test_scans_read_only_needed_columns(spark):
    from postline.sources import fixtures as fx

    plan = fx.postings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
