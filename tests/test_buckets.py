import glob
import os

from pyspark.sql import functions as F

from postline.operators import buckets, merge
from tests.conftest import frame

T1, T2 = "2026-03-01 08:00:00", "2026-03-02 08:00:00"


def batch(spark, ids, description):
    rows = [dict(seq=i, title=f"Role {i}", company="Borea", location="Denver, CO", url=f"https://borea.example/{i}", description=description) for i in ids]
    n = merge.normalize_postings(frame(spark, rows))
    return n.withColumn("match_score", F.lit(41)).withColumn("match_reason", F.lit("r")).withColumn("eligible", F.col("seq") % 10 != 9)


def files(root):
    return {p: (os.path.getmtime(p), os.path.getsize(p)) for p in glob.glob(f"{root}/bucket=*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.select(*merge.STORED_COLUMNS).collect()))


def test_only_touched_buckets_are_rewritten(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    first = merge.upsert(merge.empty_store(spark), batch(spark, range(200), "one"), T1, eligible="eligible").drop("is_new")
    buckets.create(first, root, 16)
    before = files(root)
    small = batch(spark, [3, 19, 500, 501], "two")
    own = buckets.touched(small, 16, "eligible")
    merged = buckets.merge_batch(spark, root, small, T2, "run-2", eligible="eligible")
    assert {r.url for r in merged.filter("is_new").collect()} == {"https://borea.example/500", "https://borea.example/501"}
    after = files(root)
    kept = {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in own}
    assert 1 <= len(own) <= 4 and kept and {p: before[p] for p in kept} == {p: after.get(p) for p in kept}
    assert rows(buckets.read(spark, root)) == rows(merge.upsert(first, small, T2, eligible="eligible"))
    plan = buckets.read(spark, root, own)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan

    # the same merge again (its driver was lost after the rows lay aside): nothing changes
    again = buckets.merge_batch(spark, root, small, T2, "run-2", eligible="eligible")
    assert again.filter("is_new").count() == 2
    assert rows(buckets.read(spark, root)) == rows(merge.upsert(first, small, T2, eligible="eligible"))


def test_an_empty_table_and_an_empty_batch(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    buckets.create(merge.empty_store(spark), root, 4)
    assert buckets.read(spark, root).count() == 0
    none = batch(spark, [9, 19], "ineligible")
    assert buckets.touched(none, 4, "eligible") == []
    assert buckets.merge_batch(spark, root, none, T1, "a", eligible="eligible").count() == 0
    buckets.merge_batch(spark, root, batch(spark, range(6), "x"), T1, "b", eligible="eligible")
    assert buckets.read(spark, root).count() == 6
