"""The registered queries read whole tables: every input view keeps every row."""

from postline.plans import queries as Q
from postline.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_views_cover_whole_tables(spark):
    n = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    assert fx.postings(spark, SF).count() == n("documents")
    assert fx.sightings(spark, SF).count() == n("events")
    assert fx.requests(spark, SF).count() == n("events")
    assert fx.edits(spark, SF, Q.normalized(spark, SF)).count() == n("labels")
    assert fx.sources(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
    # every posting is normalised and flagged; none is dropped before the eligibility flag
    assert Q.flagged(spark, SF).count() == n("documents")


def test_whole_texts_reach_the_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    longest = docs.orderBy(docs.n_chars.desc()).first()
    p = fx.postings(spark, SF).filter(f"seq = {longest.doc_id}").first()
    assert p.description == longest.text
