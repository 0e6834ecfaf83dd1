import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from postline.llm import line_dedup
from postline.llm.line_dedup import BLANK, line_key
from tests.llm.helpers import awkward, collected, documents, prose

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def keys(text):
    return [line_key(x) for x in (text or "").split("\n")]


def result(rows, gone):
    out = []
    for r in rows:
        every = (r[1] or "").split("\n")
        kept = [x for i, x in enumerate(every) if not gone(r, i, line_key(x))]
        out.append((r[0], len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_none(rows, min_docs, min_chars=1):
    held = Counter(k for r in rows for k in set(keys(r[1])))
    return result(rows, lambda r, i, k: len(k) >= min_chars and held[k] >= min_docs)


def plain_first(spark, rows, min_chars=1):
    hashes = {t: tuple(spark.range(1).select(F.xxhash64(F.lit(t)), F.xxhash64(F.lit(1), F.lit(t))).first()) for t in {r[1] or "" for r in rows}}
    place = lambda r, i: (r[0] is not None, r[0] or 0, hashes[r[1] or ""], i)
    first = {}
    for r in rows:
        for i, k in enumerate(keys(r[1])):
            if k not in first or place(r, i) < first[k]:
                first[k] = place(r, i)
    return result(rows, lambda r, i, k: len(k) >= min_chars and place(r, i) != first[k])


def corpus(seed, n):
    rnd = random.Random(seed)
    common = ["Share this page", "  share THIS page\t", "All rights reserved.", "ÄÖ naïve", "x" * 5000, "", " \t"]
    rare = [prose(900 + i, 4) for i in range(40)]
    return [(i, "\n".join(rnd.choice([rnd.choice(common), rnd.choice(rare), prose(seed * 1000 + i * 7 + j, 6)]) for j in range(rnd.randint(1, 12))), "en", "a") for i in range(n)]


def test_lines_in_ten_documents_go_everywhere(spark):
    rows = corpus(1, 150)
    assert collected(line_dedup.line_dedup(documents(spark, rows).repartition(6)), *COLUMNS) == plain_none(rows, 10)


def test_awkward_documents(spark):
    line = "a shared line"
    odd = [*awkward(), (20, "\n\n\n", "en", "a"), (21, "\n".join([line] * 500), "en", "a"), (None, line + "\n" + line, "en", "a"), (None, line, None, None), (22, " A SHARED line\r", "en", "a"), (22, "\x1ca shared line", "en", "a"), (23, line + " " + line, "en", "b")]
    for min_docs in (1, 2, 4, 5):
        assert collected(line_dedup.line_dedup(documents(spark, odd), min_docs=min_docs, min_chars=1), *COLUMNS) == plain_none(odd, min_docs)
    assert collected(line_dedup.line_dedup(documents(spark, odd), min_docs=1, min_chars=0), *COLUMNS) == plain_none(odd, 1, 0)
    assert line_dedup.line_dedup(documents(spark, [])).collect() == []


def test_a_hot_line_is_cut_into_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "hot line\n" + prose(i, 3) + "\nHOT LINE \nwarm " + str(i % 30), "en", "a") for i in range(240)]
        docs = documents(spark, rows)
        assert collected(line_dedup.line_dedup(docs, min_docs=8), *COLUMNS) == plain_none(rows, 8)
        assert collected(line_dedup.line_dedup(docs, min_docs=240), *COLUMNS) == plain_none(rows, 240)
        assert collected(line_dedup.line_dedup(docs, min_docs=241), *COLUMNS) == plain_none(rows, 241)
        order = ["h1", "h2", "doc_id", "t1", "t2", "pos"]
        lines = line_dedup.lines(line_dedup._identity(docs, "doc_id", "text"), 1)
        hot = lines.repartitionByRange(*order).groupBy(F.spark_partition_id().alias("p"), "h1").count().groupBy("h1").agg(F.count("p").alias("parts")).agg(F.max("parts")).first()[0]
        assert hot >= 3
        assert collected(line_dedup.line_dedup(docs, keep="first"), *COLUMNS) == plain_first(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_first_occurrences_stay(spark):
    rows = [*corpus(2, 60), *[r for r in awkward() if r[0] not in (7, 8, 9)], (5, "Share this page\nagain", "en", "a"), (5, "Share this page\nagain", "en", "a"), (None, "Share this page", "en", "a")]
    assert collected(line_dedup.line_dedup(documents(spark, rows), keep="first"), *COLUMNS) == plain_first(spark, rows)


def test_small_batches_give_the_same(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus(3, 40) + [(7, "Share this page\n" * 9, "en", "a")] * 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert collected(line_dedup.line_dedup(documents(spark, rows), min_docs=4), *COLUMNS) == plain_none(rows, 4)
        assert collected(line_dedup.line_dedup(documents(spark, rows), keep="first"), *COLUMNS) == plain_first(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bitmaps_and_texts(spark):
    rows = [(i, f"one\nshared {i}\nboiler\nlast", "en", "a") for i in range(3)]
    docs = documents(spark, rows)
    maps = line_dedup.bitmaps(docs, min_docs=3)
    assert [r.n_dropped for r in maps.collect()] == [3, 3, 3]
    assert line_dedup.kept_text("a\nb\nc\nd", line_dedup.keep_bits([0, 2])) == "b\nd" and line_dedup.kept_text("a\nb", None) == "a\nb"
    assert collected(line_dedup.apply(docs, maps), "doc_id", "text", "n_lines", "n_dropped") == [(i, f"shared {i}", 4, 3) for i in range(3)]
    assert line_key(BLANK + "Ä B" + BLANK) == "Ä b"
